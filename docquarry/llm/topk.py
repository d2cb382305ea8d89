"""Exact top-k by inner product: vectors by descending length, pruned by Cauchy-Schwarz bounds.

The Gram matrix of all vectors gives a rotation (the right singular vectors) that moves most of every
inner product into its first components. Candidates are sorted by length into blocks. The longest
ones give each query a first threshold, its k-th best score so far. Query blocks then meet candidate
blocks: a block whose longest vector can't reach the threshold isn't sent at all; inside a task, the
partial sum over the first rotated components plus the product of the residual lengths bounds a
score, and only pairs whose bound reaches the query's threshold are scored, in whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.lineage import cut
from docquarry.llm.common import bounded_batches

#: Vectors in a block of candidates, in a block of queries, and among the longest ones.
BLOCK, QUERY_BLOCK, LONGEST = 4096, 1024, 2048
#: Tasks that share the candidates of one query block, for each so many blocks.
BLOCKS_PER_TASK = 4
CHUNK = 1024
#: Share of the squared length that the first rotated components should hold.
HEAD_SHARE = 0.6


def whole_vectors(rows: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v) with v = floor(scale * embedding) as whole numbers.

    Rows with a null id, and vectors that are null or empty or hold a null or non-finite component,
    take no part. Rows that repeat id and vector count once.
    """
    finite = "x is not null and not isnan(x) and abs(x) < double('Infinity')"
    rows = rows.where(f"vec_id is not null and size(embedding) > 0 and forall(embedding, x -> coalesce({finite}, false))")
    return rows.selectExpr(
        "vec_id", f"transform(embedding, x -> cast(floor({scale} * cast(x as double)) as bigint)) v"
    ).distinct()


def _matrix(column, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros."""
    flat, ends = column.flatten().to_numpy(), column.offsets.to_numpy()
    sizes = np.diff(ends)
    if (sizes == width).all():
        return flat[: len(sizes) * width].reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    for i, (a, n) in enumerate(zip(ends[:-1] - ends[0], sizes)):
        out[i, :n] = flat[a : a + n]
    return out


def rotation(vectors: DataFrame, width: int) -> tuple[np.ndarray, int]:
    """Orthonormal columns by falling weight in all vectors, and how many hold HEAD_SHARE of it.

    The sums of a width x width matrix come to the driver.
    """

    def sums(batches):
        total = np.zeros((width, width))
        for batch in batches:
            x = _matrix(batch.column(1), width).astype(float)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width**2)), pa.array(total.ravel())], ["cell", "s"])

    found = vectors.mapInArrow(sums, "cell long, s double").groupBy("cell").agg(F.sum("s").alias("s")).toPandas()
    gram = np.zeros(width**2)
    gram[found["cell"].to_numpy()] = found["s"].to_numpy()
    values, turn = np.linalg.eigh(gram.reshape(width, width))
    order = np.argsort(values)[::-1]
    share = np.cumsum(np.maximum(values[order], 0))
    head = int(np.searchsorted(share, HEAD_SHARE * share[-1]) + 1) if share[-1] > 0 else 1
    return turn[:, order], min(width, max(1, head))


class Best:
    """The k best (score, id) of each query so far, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.score = k, np.full((n, k), np.iinfo(np.int64).min)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)

    def worst(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(q):
            return
        hit = np.unique(q)
        at = np.concatenate([q, np.repeat(hit, self.k)])
        score = np.concatenate([score, self.score[hit].ravel()])
        ids = np.concatenate([ids, self.ids[hit].ravel()])
        order = np.lexsort((ids, ~score, at))
        at, score, ids = at[order], score[order], ids[order]
        first = np.searchsorted(at, hit)
        take = first[:, None] + np.arange(self.k)
        self.score[hit], self.ids[hit] = score[take], ids[take]


def scan(best: Best, qid, q, cid, c, turn: np.ndarray, head: int, floor: np.ndarray) -> None:
    """Brings best up to date with candidates c, longest first; floor is a known k-th best score."""
    if not len(q) or not len(c):
        return
    qr, cr = q @ turn, c @ turn
    q_len, c_len = np.sqrt((qr**2).sum(1)), np.sqrt((cr**2).sum(1))
    q_rest, c_rest = np.sqrt((qr[:, head:] ** 2).sum(1)), np.sqrt((cr[:, head:] ** 2).sum(1))
    order = np.argsort(-c_len, kind="stable")
    small = float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1] < 2.0**52
    for at in range(0, len(order), CHUNK):
        part = order[at : at + CHUNK]
        least = np.maximum(best.worst(), floor)
        slack = 1e-6 + 1e-9 * q_len * c_len[part[0]]
        live = np.flatnonzero(q_len * c_len[part[0]] + slack >= least)
        if not len(live):
            break  # all later candidates are shorter
        bound = qr[live, :head] @ cr[part, :head].T + np.outer(q_rest[live], c_rest[part])
        hit = bound + slack[live, None] >= least[live, None].astype(float)
        if not hit.any():
            continue
        if small and hit.mean() > 0.05:
            full = np.rint(q[live].astype(float) @ c[part].T.astype(float)).astype(np.int64)
            i, j = np.nonzero(hit)
            score = full[i, j]
        else:
            i, j = np.nonzero(hit)
            score = np.einsum("ij,ij->i", q[live[i]], c[part[j]])
        i, j = live[i], part[j]
        good = (score >= least[i]) & (qid[i] != cid[j])
        best.add(i[good], score[good], cid[j[good]])


def _blocks(width: int, size: int, extra: tuple[str, ...] = ()):
    """Packs rows, in the order in which they come, into blocks of whole numbers."""

    def run(batches):
        held, n = [], 0

        def pack():
            table = pa.Table.from_batches(held).combine_chunks()
            x = np.ascontiguousarray(_matrix(table.column("v").chunk(0), width))
            numbers = [table.column(c).to_numpy() for c in ("vec_id", *extra)]
            length = np.sqrt((x.astype(float) ** 2).sum(1))
            need = numbers[1] / np.maximum(length, 1e-9) if extra else length
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([float(need.min() if extra else length.max())]),
                    pa.array([numbers[0].tobytes()], pa.binary()),
                    pa.array([x.tobytes()], pa.binary()),
                    pa.array([numbers[1].tobytes() if extra else b""], pa.binary()),
                ],
                ["reach", "ids", "data", "floors"],
            )

        for batch in batches:
            for at in range(0, batch.num_rows, size):
                piece = batch.slice(at, size)
                if n + piece.num_rows > size and held:
                    yield pack()
                    held, n = [], 0
                held.append(piece)
                n += piece.num_rows
        if held:
            yield pack()

    return run


_BLOCK = "reach double, ids binary, data binary, floors binary"


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of highest inner product for each query.

    Both tables have vec_id and v, as `whole_vectors` gives them. A candidate with the query's own id
    takes no part. Ties go to the smaller id; ranks start at 1; queries with fewer candidates return
    those. An empty table gives no rows.
    """
    spark = queries.sparkSession
    bounded_batches(spark)
    queries, candidates = cut(queries), cut(candidates)
    n, width = candidates.agg(F.count("*"), F.max(F.size("v"))).first()
    m, own = queries.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n or not m:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(width, own)
    turn, head = rotation(candidates, width)
    sized = candidates.withColumn("len", F.expr("aggregate(v, 0D, (a, x) -> a + cast(x as double) * x)"))
    longest = sized.orderBy(F.desc("len"), "vec_id").limit(LONGEST).select("vec_id", "v").toArrow()
    top_ids = longest.column("vec_id").to_numpy()
    top = _matrix(longest.column("v").combine_chunks() if longest.column("v").num_chunks != 1 else longest.column("v").chunk(0), width).copy()

    def started(batches):
        for batch in batches:
            qid, q = batch.column(0).to_numpy(), _matrix(batch.column(1), width)
            best = Best(len(qid), k)
            scan(best, qid, q, top_ids, top, turn, head, best.worst())
            floor = np.where(best.worst() == np.iinfo(np.int64).min, -(1 << 62), best.worst())
            length = np.maximum(np.sqrt((q.astype(float) ** 2).sum(1)), 1e-9)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(floor), pa.array(floor / length)], ["vec_id", "v", "floor", "need"]
            )

    first = queries.mapInArrow(started, "vec_id long, v array<long>, floor long, need double")
    parts = max(1, m // (4 * QUERY_BLOCK))
    q_blocks = (
        first.repartitionByRange(parts, F.desc("need"), "vec_id")
        .sortWithinPartitions(F.desc("need"), "vec_id")
        .select("vec_id", "v", "floor")
        .mapInArrow(_blocks(width, QUERY_BLOCK, ("floor",)), _BLOCK)
    )
    q_blocks = cut(q_blocks.withColumn("g", F.monotonically_increasing_id()))
    c_blocks = (
        sized.repartitionByRange(max(1, n // (4 * BLOCK)), F.desc("len"), "vec_id")
        .sortWithinPartitions(F.desc("len"), "vec_id")
        .select("vec_id", "v")
        .mapInArrow(_blocks(width, BLOCK), _BLOCK)
        .withColumn("s", F.expr(f"pmod(xxhash64(ids), {max(6, n // (BLOCK * BLOCKS_PER_TASK))})"))
    )
    shares = max(6, n // (BLOCK * BLOCKS_PER_TASK))
    # a candidate block goes to the query blocks that it can reach; one number for each of those
    reach = q_blocks.agg(F.collect_list(F.struct("g", "reach"))).first()[0]
    wanted = spark.createDataFrame([(r["g"], r["reach"]) for r in reach], "g long, least double")
    sent = c_blocks.withColumn("all", F.lit(1)).join(F.broadcast(wanted.withColumn("all", F.lit(1))), "all")
    sent = sent.where("reach * (1 + 1e-9) + 1e-6 >= least").select("g", "s", F.col("ids").alias("c_ids"), F.col("data").alias("c_data"))
    asked = q_blocks.withColumn("s", F.expr(f"explode(sequence(0, {shares - 1}))")).withColumn("s", F.col("s").cast("long"))
    met = asked.join(sent.withColumn("s", F.col("s").cast("long")), ["g", "s"]).select("g", "s", "ids", "data", "floors", "c_ids", "c_data")

    def scored(batches):
        now, state = None, None

        def out():
            qid, best = state[0], state[2]
            i, j = np.nonzero(best.ids != np.iinfo(np.int64).max)
            return pa.RecordBatch.from_arrays(
                [pa.array(qid[i]), pa.array(best.ids[i, j]), pa.array(best.score[i, j])], ["query_id", "vec_id", "score"]
            )

        for batch in batches:
            for row in batch.to_pylist():
                if (row["g"], row["s"]) != now:
                    if state:
                        yield out()
                    qid = np.frombuffer(row["ids"], np.int64)
                    q = np.frombuffer(row["data"], np.int64).reshape(-1, width)
                    now, state = (row["g"], row["s"]), (qid, q, Best(len(qid), k), np.frombuffer(row["floors"], np.int64))
                cid = np.frombuffer(row["c_ids"], np.int64)
                c = np.frombuffer(row["c_data"], np.int64).reshape(-1, width)
                scan(state[2], state[0], state[1], cid, c, turn, head, state[3])
        if state:
            yield out()

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    found = cut(met.mapInArrow(scored, "query_id long, vec_id long, score long"))
    bounded_batches(spark)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
