"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model reads whole characters, none folded, in n-grams of ORDER. Trusted documents, but for one fold of
HELD, are all counted; what is gathered grows with the input and stays in tables sharded by n-gram. Joins of
the count tables with their contexts and with the next lower order give discounts, back-off weights and
probabilities.

Documents are scored by count joins too. A block is a run of about BLOCK characters of one partition of the
documents. Each block lists its different n-grams once; the different ones of all blocks meet the tables of
every order; their scores go back to the blocks that listed them, gathered by block, where they meet the packed
texts, one block after another. So what is joined is a row for each n-gram of a block, not for each place of a text.

A document is rejected if its perplexity is above the threshold of its language, a quantile over that
language's trusted documents of the fold that was not counted, with a margin.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.lineage import cut, drop, settings, stored, tidied
from docquarry.llm import filters
from docquarry.llm.common import bounded_batches, narrow, releasing
from docquarry.operators.skew import spread_join

ORDER = 5
#: One in so many trusted texts, by a hash of the text, isn't counted: thresholds come from those.
HELD = 5
#: Quantile of the held-out trusted documents of a language, and what is added to the log2 perplexity there.
QUANTILE, MARGIN = 0.99, 0.12
#: A text is judged as if so many symbols of its language's median stood behind it: a few words are
#: little evidence.
PRIOR = 64
#: Characters worked on at once, and characters of a block.
PART, BLOCK = 1 << 20, 32 << 20
#: Scored n-grams that a task gathers by block at once.
BUNDLE = 1 << 18
#: Level at which texts that move are compressed.
LEVEL = 6

#: Which texts are held out (0), by a hash of the text.
_FOLD = f"cast(pmod({{}}, {HELD}) as int)"

_PAD = "\n" * (ORDER - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LISTED = "block long, gram string"
_PACKED = "block long, ids array<long>, langs array<string>, hashes array<long>, sizes array<long>, bytes long, texts binary"


def hashed(joined: str) -> np.ndarray:
    """64-bit hashes of all runs of ORDER characters."""
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = max(len(points) - ORDER + 1, 0)
    code = np.zeros(n, np.uint64)
    for i in range(ORDER):
        code *= _MIX
        code += points[i : i + n]
    return code


def windows(texts):
    """(joined, rows, codes, starts) of about PART characters of the texts at once: the number of the text, the
    hash and the place in `joined` of each n-gram. A text has as many n-grams as characters, as it stands
    behind line ends."""
    held, rows, sizes, total = [], [], [], 0

    def flush():
        size = np.array(sizes)
        ends = np.cumsum(size)
        starts = np.arange(ends[-1]) + np.repeat(np.arange(len(size)) * (ORDER - 1), size)
        joined = "".join(held)
        return joined, np.repeat(np.array(rows), size), hashed(joined)[starts], starts

    for row, text in enumerate(texts):
        padded = _PAD + (text or "")
        for at in range(0, len(padded) - ORDER + 1, PART):
            held.append(padded[at : at + PART + ORDER - 1])
            rows.append(row)
            sizes.append(len(held[-1]) - ORDER + 1)
            total += sizes[-1]
            if total >= PART:
                yield flush()
                held, rows, sizes, total = [], [], [], 0
    if held:
        yield flush()


class Places:
    """The place of each of some different codes in the array of them.

    Most are found by one look at a table, those whose slot another code took by a binary search.
    """

    def __init__(self, codes: np.ndarray):
        self.codes = np.append(codes, np.uint64(0))
        bits = max(int(len(codes)).bit_length() + 3, 10)
        self.shift = np.uint64(64 - bits)
        self.table = np.full(1 << bits, len(codes), np.int32)
        slot = self._slot(codes)
        self.table[slot] = np.arange(len(codes), dtype=np.int32)
        late = np.flatnonzero(self.table[slot] != np.arange(len(codes)))
        self.late = late[np.argsort(codes[late])]
        self.late_codes = codes[self.late]

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return (codes * _MIX) >> self.shift

    def find(self, codes: np.ndarray) -> np.ndarray:
        """The places, -1 where a code isn't there."""
        at = self.table[self._slot(codes)]
        none = np.int32(len(self.codes) - 1)
        missed = np.flatnonzero((self.codes[at] != codes) | (at == none))
        at[missed] = -1
        if len(self.late) and len(missed):
            left = codes[missed]
            near = np.minimum(np.searchsorted(self.late_codes, left), len(self.late) - 1)
            found = self.late_codes[near] == left
            at[missed[found]] = self.late[near[found]]
        return at


def _texts_at_once(batches, column: int):
    """Lists of texts of about PART characters over the batches."""
    held, size = [], 0
    for batch in batches:
        for text in batch.column(column).to_pylist():
            held.append(text)
            size += len(text or "")
            if size >= PART:
                yield held
                held, size = [], 0
    yield held


def _counts(batches):
    for texts in _texts_at_once(batches, 0):
        for joined, _, codes, starts in windows(texts):
            _, first, n = np.unique(codes, return_index=True, return_counts=True)
            grams = [joined[s : s + ORDER] for s in starts[first].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(n.astype(np.int64))], ["gram", "n"])


def _blocks(batches):
    """(block, rows) in the order of a partition; both passes over the same rows give the same blocks.

    rows are lists of the values of the columns behind the first, which is the number of the partition."""
    size, number = 0, 0
    for batch in batches:
        part = batch.column(0)[0].as_py() if batch.num_rows else 0
        columns = [batch.column(i).to_pylist() for i in range(1, batch.num_columns)]
        yield (part << 24) + number, columns
        size += sum(len(t or "") for t in columns[0])
        if size >= BLOCK:
            size, number = 0, number + 1


def _listed(batches):
    none = Places(np.zeros(0, np.uint64))
    now, known, held, size = None, none, [], 0

    def fresh():
        nonlocal known
        for joined, _, codes, starts in windows(held):
            other = np.flatnonzero(known.find(codes) < 0)
            new, first = np.unique(codes[other], return_index=True)
            if len(new):
                known = Places(np.concatenate([known.codes[:-1], new]))
                grams = [joined[s : s + ORDER] for s in starts[other[first]].tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(grams), now, np.int64)), pa.array(grams, pa.string())], ["block", "gram"]
                )

    for block, (texts,) in _blocks(batches):
        if block != now or size >= 4 * PART:
            yield from fresh()
            held, size = [], 0
        if block != now:
            now, known = block, none
        held += texts
        size += sum(len(t or "") for t in texts)
    yield from fresh()


def _packed(batches):
    codec = pa.Codec("zstd", compression_level=LEVEL)
    types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
    names = ["block", "ids", "langs", "hashes", "sizes", "bytes", "texts"]
    for block, (texts, ids, langs, hashes) in _blocks(batches):
        data = "".join(t or "" for t in texts).encode("utf-8", "surrogatepass")
        row = (block, ids, langs, hashes, [len(t or "") for t in texts], len(data), codec.compress(data, asbytes=True))
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)


def _bundled(batches):
    """The n-grams of each block, one behind another, with their bits: a row for each block of BUNDLE rows."""

    def flush():
        table = pa.Table.from_batches(held).sort_by("block")
        blocks, bits, grams = table["block"].to_numpy(), table["bits"].to_numpy(), table["gram"].to_pylist()
        edges = (np.flatnonzero(np.diff(blocks)) + 1).tolist()
        spans = list(zip([0, *edges], [*edges, len(blocks)]))
        return pa.RecordBatch.from_arrays(
            [pa.array(blocks[[lo for lo, _ in spans]]), pa.array(["".join(grams[lo:hi]) for lo, hi in spans], pa.string()),
             pa.array([bits[lo:hi].tobytes() for lo, hi in spans], pa.binary())],
            ["block", "grams", "bits"],
        )

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= BUNDLE:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def _scored(batches):
    """Rows come by block, its scored n-grams before its packed texts."""
    codec = pa.Codec("zstd")
    now, keys, bits, ready = None, [], [], False
    for batch in batches:
        blocks, packs = batch.column(0).to_numpy(), batch.column("pack")
        packed = packs.is_valid().to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(packed.astype(np.int8)) != 0)) + 1
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(blocks)]):
            if lo == hi:
                continue
            if blocks[lo] != now:
                now, keys, bits, ready = blocks[lo], [], [], False
            if not packed[lo]:
                for grams in batch.column("grams").slice(lo, hi - lo).to_pylist():
                    keys.append(hashed(grams)[::ORDER])
                bits += [np.frombuffer(x) for x in batch.column("bits").slice(lo, hi - lo).to_pylist()]
                continue
            if not ready:
                known = Places(np.concatenate(keys) if keys else np.zeros(0, np.uint64))
                worth = np.concatenate(bits) if bits else np.zeros(0)
                ready = True
            for row in packs.slice(lo, hi - lo).to_pylist():
                text = codec.decompress(row["texts"], row["bytes"], asbytes=True).decode("utf-8", "surrogatepass")
                ends = np.cumsum(row["sizes"]).tolist()
                total = np.zeros(len(ends))
                for _, rows, codes, _ in windows([text[e - s : e] for s, e in zip(row["sizes"], ends)]):
                    at = known.find(codes)
                    if (at < 0).any():
                        raise RuntimeError("the documents gave other rows when they were read again")
                    total += np.bincount(rows, worth[at], len(total))
                each = [-t / s if s else None for t, s in zip(total.tolist(), row["sizes"])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], pa.int64()), pa.array(row["langs"], pa.string()), pa.array(row["hashes"], pa.int64()),
                     pa.array(row["sizes"], pa.int64()), pa.array(each, pa.float64())],
                    ["doc_id", "lang", "text_hash", "symbols", "bits"],
                )


def trusted_rows(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is in trusted. A Bloom filter keeps most other texts from moving."""
    ids = trusted.select("doc_id").where("doc_id is not null").distinct()
    words = filters.filter_words(ids.count())
    built = filters.build(ids.selectExpr("xxhash64(doc_id) h"), words)
    maybe = filters.tested(docs.withColumn("h", F.expr("xxhash64(doc_id)")), "h", words, built)
    return maybe.where("maybe").drop("h", "maybe").join(ids, "doc_id", "left_semi")


def _discounts(counts: DataFrame) -> list[float]:
    """D1, D2 and D3+ of an order, from how many n-grams occur once to four times."""
    row = counts.agg(*[F.count(F.when(F.col("n") == k, 1)) for k in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (float(x) for x in row)
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    raw = [k - (k + 1) * y * b / a if a else float(min(k, 2)) * 0.5 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return [min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), raw)]


def probabilities(grams: DataFrame, counts: DataFrame) -> DataFrame:
    """(gram, p): the probability of the last symbol of every different `gram`, given those before.

    counts has (gram, n) of the n-grams of ORDER symbols that were seen. The orders below count the different
    symbols in front of each of their n-grams. Below the lowest stands an even share for each symbol seen and
    one for all others; so it is where nothing was seen.
    """
    seen = [cut(counts)]
    for _ in range(1, ORDER):
        seen.append(cut(seen[-1].groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n"))))
    wanted = [grams]
    for _ in range(1, ORDER):
        wanted.append(cut(wanted[-1].select(F.expr("substring(gram, 2)").alias("gram")).distinct()))
    below, base = None, 1.0 / (seen[-1].count() + 1)
    for k, (own, asked) in enumerate(zip(reversed(seen), reversed(wanted)), 1):
        d1, d2, d3 = _discounts(own)
        taken = f"if(n = 1, {d1}D, if(n = 2, {d2}D, {d3}D))"
        own = own.selectExpr("gram", "n", f"left(gram, {k - 1}) context")
        contexts = own.groupBy("context").agg(F.sum("n").alias("total"), F.expr(f"sum({taken}) taken"))
        rows = asked.selectExpr("gram", f"left(gram, {k - 1}) context", "substring(gram, 2) suffix")
        rows = rows.join(own.select("gram", "n"), "gram", "left").join(contexts, "context", "left")
        if below is None:
            rows = rows.withColumn("below", F.lit(base))
        else:
            rows = rows.join(below.withColumnsRenamed({"gram": "suffix", "p": "below"}), "suffix")
        p = f"coalesce((n - {taken}) / total, 0D) + coalesce(taken / total, 1D) * below p"
        then = cut(rows.selectExpr("gram", p))
        if below is not None:
            drop(below)
        below = then
    drop(*seen, *wanted[1:])
    return below


#: Parts of a plan that give the same rows in the same partitions whenever they are run.
_STEADY = {"Project", "Filter", "LogicalRelation", "LocalRelation", "LogicalRDD"}


def steady(docs: DataFrame) -> DataFrame:
    """docs if it is a projection or filter of files, else its rows as written to the shared folder: rows are read
    more than once, and joins and shuffles may deal them otherwise each time."""
    found, left = True, [docs._jdf.queryExecution().optimizedPlan()]
    while left:
        node = left.pop()
        found = found and node.nodeName().split()[0] in _STEADY and node.deterministic()
        children = node.children()
        left += [children.apply(k) for k in range(children.size())]
    return docs if found else stored(docs)


def _as_split_now(spark) -> dict[str, str]:
    """Settings by which files are split in the same way although executors come and go."""
    parts = spark.conf.get("spark.sql.files.minPartitionNum", None) or str(spark.sparkContext.defaultParallelism)
    return {"spark.sql.files.minPartitionNum": parts}


def perplexities(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(doc_id, lang, text_hash, symbols, bits) of every row: bits for each symbol, null for texts without any.

    Texts that fold() holds out aren't counted. docs is read three times; its rows are written to the shared folder
    first unless they come straight from files.
    """
    docs = steady(docs.select("doc_id", "text", "lang"))
    with settings(docs.sparkSession, _as_split_now(docs.sparkSession)):
        return _perplexities(docs, trusted)


def _perplexities(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    fold = _FOLD.format("xxhash64(text)")
    counted = narrow(trusted_rows(docs.select("doc_id", "text"), trusted).where(f"{fold} <> 0"), "text")
    counts = counted.mapInArrow(releasing(_counts), "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    part = "cast(spark_partition_id() as bigint) part"
    listed = cut(narrow(docs, part, "text").mapInArrow(releasing(_listed), _LISTED))
    blocks = listed.agg(F.countDistinct("block")).first()[0]
    grams = cut(listed.select("gram").distinct())
    probs = probabilities(grams, counts)
    drop(grams)
    packed = narrow(docs, part, "text", "cast(doc_id as bigint) doc_id", "lang", "xxhash64(text) text_hash").mapInArrow(releasing(_packed), _PACKED)
    packed = packed.select("block", F.struct(*[c for c in packed.columns if c != "block"]).alias("pack"))
    worth = listed.join(probs, "gram").selectExpr("block", "gram", "log2(p) bits")
    worth = worth.mapInArrow(releasing(_bundled), "block long, grams string, bits binary")
    rows = worth.unionByName(packed, allowMissingColumns=True).select("block", "grams", "bits", "pack")
    bounded_batches(docs.sparkSession)
    scored = rows.repartition(max(blocks, 1), "block").sortWithinPartitions("block", F.col("pack").isNotNull())
    scored = cut(scored.mapInArrow(releasing(_scored), "doc_id long, lang string, text_hash long, symbols long, bits double"))
    drop(listed, probs)
    return scored


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents that a label calls good, and none calls bad or toxic."""
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic")
    )
    return marks.where("quality = 1 and toxic = 0").select("doc_id")


@tidied
def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lang, text_hash, perplexity, threshold, kept) for every row of docs; text_hash is xxhash64 of the text.

    Languages without held-out trusted documents, and rows without a language, take the threshold of all
    held-out trusted documents together; without any such document all are kept. Null and empty texts have
    no perplexity and are kept. Repeated rows give repeated results; an empty table gives none. Very long
    texts are read whole, in parts.
    """
    trusted = trusted_ids(labels)
    scored = perplexities(docs, trusted)
    good = scored.where(f"{_FOLD.format('text_hash')} = 0 and bits is not null").join(trusted, "doc_id", "left_semi")
    limits = [
        F.expr("percentile_approx(bits, 0.5, 10000) usual"),
        F.expr(f"percentile_approx(bits, {QUANTILE}, 10000) + {MARGIN} top"),
    ]
    by_lang = good.where("lang is not null").groupBy("lang").agg(*limits)
    usual, top = (F.lit(x).cast("double") for x in good.agg(*limits).first())
    rows = spread_join(scored, by_lang, "lang", kind="left").withColumns(
        {"usual": F.coalesce("usual", usual), "top": F.coalesce("top", top)}
    )
    return rows.selectExpr(
        "doc_id", "lang", "text_hash", "pow(2D, bits) perplexity", "pow(2D, top) threshold",
        f"coalesce((bits * symbols + usual * {PRIOR}) / (symbols + {PRIOR}) <= top, true) kept",
    )


@tidied
def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are kept. Rows are told apart by doc_id, language and a 64-bit hash of the text, whose
    verdict is the same wherever they stand; all columns stay as they are."""
    docs = steady(docs)
    key = ["doc_id", "lang", "text_hash"]
    bad = judge(docs, labels).where("not kept").select(*[F.col(c).alias(f"_bad_{c}") for c in key]).distinct()
    own = {"doc_id": docs["doc_id"], "lang": docs["lang"], "text_hash": F.xxhash64(docs["text"])}
    same = [own[c].cast(bad.schema[f"_bad_{c}"].dataType).eqNullSafe(bad[f"_bad_{c}"]) for c in key]
    return docs.join(bad, same, "left_anti")
