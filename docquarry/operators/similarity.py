"""All pairs of vectors by matrix products of blocks.

Rows are dealt by a hash of their ids over blocks of at most about BLOCK rows of one group, so that a
group of any size becomes many blocks. Pairs of blocks meet in an equality join on the group and the
second block; whatever is asked of the pairs (nearest ones, those above a bound, sums) is taken from the
product of two blocks in numpy and leaves the task as few rows, which Spark then combines. Products run
over strips of rows, so that no more than STRIP x BLOCK scores are held at once.

Similarities are cosines in double precision, rounded to `digits`; vectors that are null, empty, of no
length or hold null or non-finite numbers take no part, and vectors of different lengths are not compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.session import ship_package

#: Rows of a block, bytes of its vectors, and rows of it that are multiplied at once.
BLOCK, BYTES, STRIP = 4096, 4 << 20, 512
#: Bytes after which a batch of pairs of blocks goes to Python; without it a task's pairs go there together.
BATCH = 8 << 20


def _vectors(rows: DataFrame, id_col: str, group: Column, vector: str) -> DataFrame:
    found = rows.select(F.col(id_col).cast("long").alias("id"), group.alias("g"), F.col(vector).cast("array<double>").alias("v"))
    sound = "v is not null and id is not null and g is not null and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0)"
    return found.where(sound).withColumn("d", F.size("v"))


def _blocks(vectors: DataFrame, side: str, size: int) -> DataFrame:
    """(g, d, blocks, block, <side>): lists of the rows of a block; a group of n rows has n / size blocks, more where long vectors
    would make these more than BYTES."""
    rows = f"least({size}, greatest({BYTES} div (8 * d), 64))"
    counts = vectors.groupBy("g", "d").agg(F.count("*").alias("n")).selectExpr("g", "d", f"cast(ceil(n / {rows}) as int) blocks")
    dealt = vectors.join(counts, ["g", "d"]).withColumn("block", F.expr("cast(pmod(xxhash64(id), blocks) as int)"))
    return dealt.groupBy("g", "d", "blocks", "block").agg(F.collect_list(F.struct("id", "v")).alias(side))  # about `size` rows


def _unit(column, row: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, unit vectors) of one list of rows, in the order of ids."""
    own = column.slice(row, 1).flatten()
    ids = own.field(0).to_numpy(zero_copy_only=False)
    flat = own.field(1).flatten().to_numpy(zero_copy_only=False)
    v = flat.reshape(len(ids), -1)
    order = np.argsort(ids, kind="stable")
    v = v[order]
    return ids[order], v / np.sqrt((v * v).sum(1))[:, None]


def _strips(batches, digits: int, same: bool):
    """(group, row ids, column ids, rounded scores) of strips of every pair of blocks; of two rows of one table
    each pair comes once, the smaller id's row against the larger's column, others as -inf."""
    for batch in batches:
        groups = batch.column(0)
        for k in range(batch.num_rows):
            ids, rows = _unit(batch.column(1), k)
            others, columns = _unit(batch.column(2), k)
            turns = [(ids, rows, others, columns)]
            if same and not batch.column(3)[k].as_py():
                turns.append((others, columns, ids, rows))
            for a, u, b, w in turns:
                for at in range(0, len(a), STRIP):
                    part = a[at : at + STRIP]
                    scores = np.round(u[at : at + STRIP] @ w.T, digits)
                    if same:
                        scores[part[:, None] >= b[None, :]] = -np.inf
                    yield groups[k].as_py(), part, b, scores


def _tiles(left: DataFrame, right: DataFrame | None, size: int) -> DataFrame:
    """(g, left, right, own): all pairs of blocks of a group; without a second table each unordered pair once."""
    if right is None:
        blocks = _blocks(left, "right", size)
        a = blocks.select("g", "d", F.col("block").alias("first"), F.col("right").alias("left"), F.expr("explode(sequence(block, blocks - 1)) block"))
        met = a.join(blocks.drop("blocks"), ["g", "d", "block"])
        return met.select("g", "left", "right", F.expr("first = block own"))
    a, b = _blocks(left, "left", size), _blocks(right, "right", size)
    counts = b.select("g", "d", F.col("blocks").alias("n")).distinct()
    a = a.drop("blocks", "block").join(counts, ["g", "d"]).select("g", "d", "left", F.expr("explode(sequence(0, n - 1)) block"))
    return a.join(b.drop("blocks"), ["g", "d", "block"]).select("g", "left", "right", F.lit(False).alias("own"))


def _prepared(left, right, id_col, group, vector, size):
    ship_package(left.sparkSession)
    left.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    own = F.lit(0) if group is None else F.col(group)
    kind = "int" if group is None else left.schema[group].dataType.simpleString()
    a = _vectors(left, id_col, own, vector)
    b = None if right is None else _vectors(right, id_col, own, vector)
    return _tiles(a, b, size), kind


def _first_k(scores: np.ndarray, k: int) -> np.ndarray:
    """Mask of the k highest of each row, ties to the first columns; -inf takes no part."""
    live = scores > -np.inf
    if scores.shape[1] <= k:
        return live
    bound = np.partition(scores, -k, axis=1)[:, -k][:, None]
    above, equal = scores > bound, (scores == bound) & live
    room = k - above.sum(1, keepdims=True)
    return above | (equal & (np.cumsum(equal, axis=1) <= room))


def nearest(
    rows: DataFrame, k: int, least: float | None = None, queries: DataFrame | None = None, group: str | None = "label",
    id_col: str = "vec_id", vector: str = "embedding", digits: int = 6, size: int = BLOCK,
) -> DataFrame:
    """(id1, id2, sim): for each row its k most similar rows, ties to the smaller id, within its group.

    Without queries a row's partners are the rows with a larger id. With queries, a table of the same
    columns, they are all rows with another id. The bound `least` applies to those k. Every pair of blocks
    gives at most k partners a row; the k best of all are found by a window that cuts off before and after
    the shuffle.
    """
    same = queries is None
    tiles, _ = _prepared(rows if same else queries, None if same else rows, id_col, group, vector, size)

    def run(batches):
        for _, ids, others, scores in _strips(batches, digits, same):
            if not same:
                scores[ids[:, None] == others[None, :]] = -np.inf
            if least is not None:
                scores[scores < least] = -np.inf
            a, b = np.nonzero(_first_k(scores, k))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(others[b]), pa.array(scores[a, b])], ["id1", "id2", "sim"])

    found = tiles.mapInArrow(run, "id1 long, id2 long, sim double")
    best = Window.partitionBy("id1").orderBy(F.desc("sim"), "id2")
    return found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")


def pairs_above(
    left: DataFrame, least: float, right: DataFrame | None = None, group: str | None = "label",
    id_col: str = "vec_id", vector: str = "embedding", digits: int = 6, size: int = BLOCK,
) -> DataFrame:
    """(id1, id2, sim): all pairs of a similarity of `least` or more; of one table each pair once, id1 < id2."""
    same = right is None
    tiles, _ = _prepared(left, right, id_col, group, vector, size)

    def run(batches):
        for _, ids, others, scores in _strips(batches, digits, same):
            a, b = np.nonzero(scores >= least)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(others[b]), pa.array(scores[a, b])], ["id1", "id2", "sim"])

    return tiles.mapInArrow(run, "id1 long, id2 long, sim double")


def best_partners(
    queries: DataFrame, rows: DataFrame, k: int, least: float, id_col: str = "vec_id", vector: str = "embedding", digits: int = 6, size: int = BLOCK
) -> DataFrame:
    """(id1, id2, sim): for each query its k most similar rows of `least` or more, ties to the smaller id, without groups.

    Tiles with the same block of queries follow each other in a task, which merges them, so that it gives k rows
    a query however many blocks of rows there are.
    """
    # the block of rows is the one that is copied: the join streams the copies past each block of queries
    tiles, _ = _prepared(rows, queries, id_col, None, vector, size)

    def run(batches):
        asked, best, partners = None, None, None

        def found():
            a, b = np.nonzero(best > -np.inf)
            return pa.RecordBatch.from_arrays([pa.array(asked[a]), pa.array(partners[a, b]), pa.array(best[a, b])], ["id1", "id2", "sim"])

        for batch in batches:
            for n in range(batch.num_rows):
                others, columns = _unit(batch.column(1), n)
                ids, unit = _unit(batch.column(2), n)
                if asked is None or not np.array_equal(asked, ids):
                    if asked is not None:
                        yield found()
                    asked, best, partners = ids, np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)
                for at in range(0, len(ids), STRIP):
                    part = slice(at, at + STRIP)
                    scores = np.round(unit[part] @ columns.T, digits)
                    scores[scores < least] = -np.inf
                    a, b = np.nonzero(_first_k(scores, k))
                    place = np.arange(len(a)) - np.searchsorted(a, a)
                    more, whose = np.full((len(scores), k), -np.inf), np.zeros((len(scores), k), np.int64)
                    more[a, place], whose[a, place] = scores[a, b], others[b]
                    more, whose = np.hstack([best[part], more]), np.hstack([partners[part], whose])
                    first = np.lexsort((whose, -more), axis=-1)[:, :k]
                    best[part], partners[part] = np.take_along_axis(more, first, 1), np.take_along_axis(whose, first, 1)
        if asked is not None:
            yield found()

    parts = tiles.mapInArrow(run, "id1 long, id2 long, sim double")
    order = Window.partitionBy("id1").orderBy(F.desc("sim"), "id2")
    return parts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def bands(
    rows: DataFrame, group: str = "label", id_col: str = "vec_id", vector: str = "embedding", digits: int = 6, size: int = BLOCK
) -> DataFrame:
    """(<group>, n, total, top): count, sum and maximum of the similarities of all pairs of a group."""
    tiles, kind = _prepared(rows, None, id_col, group, vector, size)

    def run(batches):
        for name, _, _, scores in _strips(batches, digits, True):
            live = scores > -np.inf
            if n := int(live.sum()):
                part = [[name], [n], [float(scores[live].sum())], [float(scores.max())]]
                yield pa.RecordBatch.from_arrays([pa.array(p, t) for p, t in zip(part, types)], ["g", "n", "total", "top"])

    schema = f"g {kind}, n long, total double, top double"
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(rows.schema[group].dataType), pa.int64(), pa.float64(), pa.float64()]
    parts = tiles.mapInArrow(run, schema)
    return parts.groupBy(F.col("g").alias(group)).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("top").alias("top"))
