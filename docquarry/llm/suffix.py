"""Removal of byte strings that repeat, by suffix arrays that the difference-cover algorithm builds.

Every 50-byte string of a text is filed under its minimizer, the smallest hash of the 24-byte strings
in it; equal strings have equal minimizers. Neighbouring starts with one minimizer form a stretch.

1. The minimizers of all stretches are counted, sharded by value. Those that occur twice or more
   enter a Bloom filter; a string under any other minimizer cannot repeat.
2. Stretches under repeated minimizers are folded by content, keeping the smallest doc_id, and go to
   the shard of their minimizer; what was folded and where it stood is written once, to the shared
   checkpoint folder. So each shard has all the places of its strings, and no text of one
   shard need be compared with another's.
3. A shard joins its stretches into one text and sorts its suffixes by the difference-cover
   algorithm: triples at positions that are not multiples of three are sorted and named, the names
   are sorted by recursion, the other suffixes are merged in. Suffixes whose neighbours in this order
   share their first 50 bytes form a group, whose smallest doc_id goes to every start in it.
4. The starts of a document whose string has an earlier document are joined into spans, taken out.

Stretches under a minimizer that is very frequent are filed by the hash of each single string
instead, so that no shard has to take all contexts of a common passage.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.lineage import cut, tidied
from docquarry.llm import filters
from docquarry.llm.common import bounded_batches, narrow

LENGTH = 50
#: Bytes under one minimizer.
GRAM = 24
#: Keys in one counting shard and bytes of text in one sorting shard, as aims.
KEYS_PER_SHARD, BYTES_PER_SHARD = 1 << 21, 1 << 21
#: Stretches of a minimizer from which its strings are filed one by one.
FREQUENT = 100_000
#: Stretches that a task folds before it sends them.
HELD = 200_000
KEY_BITS = 48

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


# --- the difference-cover algorithm


def _names(parts: list[np.ndarray]) -> tuple[np.ndarray, int]:
    """Ranks, from 1, of rows of columns, and how many different ones there are."""
    first, *rest = parts
    size = int(max(p.max() for p in parts)) + 1
    if size ** len(parts) <= 1 << 25:  # few symbols: a table of all combinations instead of a sort
        for column in rest:
            first = first * size + column
        table = np.zeros(size ** len(parts), np.int32)
        table[first] = 1
        np.cumsum(table, out=table)
        return table[first].astype(np.int64), int(table[-1])
    for column in rest:
        top = int(column.max()) + 1
        if int(first.max()) >= (1 << 62) // top:
            _, first = np.unique(first, return_inverse=True)
        first = first.astype(np.int64) * top + column
    values, ranks = np.unique(first, return_inverse=True)
    return ranks.astype(np.int64) + 1, len(values)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of a sequence of whole numbers over 0, in order."""
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    s = np.concatenate([text.astype(np.int64) + 1, np.zeros(3, np.int64)])
    # a sample of triples, in the order of the reduced text: all starts of 1, then all of 2, modulo 3
    one = np.arange(1, n + (n % 3 == 1), 3)
    two = np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    names, different = _names([s[sample], s[sample + 1], s[sample + 2]])
    if different < len(sample):
        order = suffix_array(names)
    else:
        order = np.argsort(names)
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sample = sample[order]
    sample = sample[sample < n]
    # the others, by their first symbol and the rank behind it
    zero = np.arange(0, n, 3)
    width = len(rank) + 1
    key0 = s[zero] * width + rank[zero + 1]
    by = np.argsort(key0, kind="stable")
    zero, key0 = zero[by], key0[by]
    # where they fall among the sample's two kinds: each kind has a key in which both are comparable
    ones, twos = sample[sample % 3 == 1], sample[sample % 3 == 2]
    before = np.searchsorted(s[ones] * width + rank[ones + 1], key0)
    pair = _pairs(s)
    before += np.searchsorted(pair[twos] * width + rank[twos + 2], pair[zero] * width + rank[zero + 2])
    out = np.empty(n, np.int64)
    at = before + np.arange(len(zero))
    out[at] = zero
    rest = np.ones(n, bool)
    rest[at] = False
    out[rest] = sample
    return out


def _pairs(s: np.ndarray) -> np.ndarray:
    """Ranks of the symbol pairs at each start."""
    ranks, _ = _names([s[:-1], s[1:]])
    return np.append(ranks, 0)


# --- minimizers and stretches


def _window(data: bytes, at: int, n: int) -> np.ndarray:
    return np.ndarray((n,), "<u8", data, at, (1,))


def stretches(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First starts of the stretches of a text and their minimizers; the last start is len - LENGTH."""
    n = len(data) - GRAM + 1
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = _window(data, 0, n) * _A
    h ^= h >> np.uint64(29)
    h += _window(data, 8, n)
    h *= _B
    h ^= h >> np.uint64(32)
    h += _window(data, 16, n)
    h *= _C
    h ^= h >> np.uint64(29)
    h *= _A
    h >>= np.uint64(64 - KEY_BITS)
    size, width = 1, LENGTH - GRAM + 1
    while 2 * size <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    if size < width:
        h = np.minimum(h[: len(h) - (width - size)], h[width - size :])
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    # minima are small numbers; an odd factor spreads them over all keys
    return first, h[first] * _C & np.uint64((1 << KEY_BITS) - 1)


def _bits(keys: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of each key in a Bloom filter, by its top bits, and the mask of its two bits there."""
    h = keys * _B
    h ^= h >> np.uint64(31)
    h *= _A
    one, two = (h >> np.uint64(40)) & np.uint64(63), (h >> np.uint64(50)) & np.uint64(63)
    word = keys >> np.uint64(KEY_BITS - words.bit_length() + 1)
    return word.astype(np.int64), (np.uint64(1) << one) | (np.uint64(1) << two)


def _has(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    word, mask = _bits(keys, len(table))
    return table[word] & mask == mask


def _press(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _unpress(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _keys(shards: int):
    """(shard, keys, counts): the minimizers of a task, each once, by shard; compressed.

    A shard, of a power of two, has the keys of one range.
    """

    def out(held):
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        cuts = np.searchsorted(keys, np.arange(1, shards, dtype=np.uint64) << np.uint64(KEY_BITS - shards.bit_length() + 1))
        rows = [(k, a, b) for k, (a, b) in enumerate(zip(np.split(keys, cuts), np.split(n, cuts))) if len(a)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int32()),
                pa.array([_press(np.diff(r[1], prepend=np.uint64(0))) for r in rows], pa.binary()),
                pa.array([_press(np.minimum(r[2], 1 << 31).astype(np.uint32)) for r in rows], pa.binary()),
            ],
            ["shard", "keys", "counts"],
        )

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = stretches(text or b"")[1]
                held.append(found)
                n += len(found)
            if n > KEYS_PER_SHARD:
                yield out(held)
                held, n = [], 0
        if n:
            yield out(held)

    return run


def _repeated(words: int, shards: int):
    """(shard, repeated, frequent, n) of a counting shard: its words of the two filters, compressed,
    and how many minimizers are repeated."""
    own = words // shards

    def run(key, table):
        shard = table.column("shard")[0].as_py()
        keys = np.concatenate([np.cumsum(_unpress(x, np.uint64), dtype=np.uint64) for x in table.column("keys").to_pylist()])
        counts = np.concatenate([_unpress(x, np.uint32) for x in table.column("counts").to_pylist()])
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, total = keys[first], np.add.reduceat(counts, first)
        parts = []
        for least in (2, FREQUENT):
            word, mask = _bits(keys[total >= least], words)
            part = np.zeros(own, np.uint64)
            np.bitwise_or.at(part, word - shard * own, mask)
            parts.append(_press(part))
        row = [pa.array([shard], pa.int32()), *(pa.array([p], pa.binary()) for p in parts), pa.array([int((total >= 2).sum())], pa.int64())]
        return pa.table(row, ["shard", "repeated", "frequent", "n"])

    return run


def repeated_minimizers(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bloom filters of the repeated and of the frequent minimizers, and how many are repeated.

    size is the number of bytes of all texts. The filters have at most filters.MAX_BITS bits each.
    """
    words = filters.filter_words(size // 256)
    shards = min(words, 1 << max(12, size // (12 * KEYS_PER_SHARD)).bit_length())
    found = (
        narrow(docs, "cast(text as binary) text")
        .mapInArrow(_keys(shards), "shard int, keys binary, counts binary")
        .groupBy("shard")
        .applyInArrow(_repeated(words, shards), "shard int, repeated binary, frequent binary, n long")
        .toArrow()
    )
    tables = np.zeros((2, shards, words // shards), np.uint64)
    for row in found.to_pylist():
        for table, part in zip(tables, (row["repeated"], row["frequent"])):
            table[row["shard"]] = _unpress(part, np.uint64)
    return tables[0].ravel(), tables[1].ravel(), sum(found.column("n").to_pylist())


def _units(data: bytes, table: np.ndarray, frequent: np.ndarray):
    """(first start, end, key) of the byte strings of a text that may hold repeats."""
    first, keys = stretches(data)
    if not len(first):
        return
    last = np.append(first[1:], len(data) - LENGTH + 1) + LENGTH - 1
    hit = np.flatnonzero(_has(keys, table))
    often = _has(keys[hit], frequent)
    for a, b, key, many in zip(first[hit].tolist(), last[hit].tolist(), keys[hit].tolist(), often.tolist()):
        if not many:
            yield a, b, key
        else:
            for s in range(a, b - LENGTH + 1):
                yield s, s + LENGTH, xxhash.xxh3_64_intdigest(data[s : s + LENGTH], 1) >> (64 - KEY_BITS)


class _Blocks:
    """Different byte strings of a stretch of a task, with their keys and smallest doc_ids, and where
    they are. A block gets the same number whenever its partition is read again."""

    def __init__(self, shards: int):
        self.shards, self.count = shards, 0
        self.part = TaskContext.get().partitionId()
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.keys: list[int] = []
        self.firsts: list[int] = []
        self.places: list[tuple[int, int, int]] = []

    def add(self, doc: int, data: bytes, units) -> None:
        for a, b, key in units:
            text = data[a:b]
            at = self.known.get(text)
            if at is None:
                at = self.known[text] = len(self.keys)
                self.keys.append(key)
                self.firsts.append(doc)
            elif doc < self.firsts[at]:
                self.firsts[at] = doc
            self.places.append((doc, a, at))

    def number(self) -> int:
        self.count += 1
        return (self.part << 24) | self.count

    def split(self) -> tuple[np.ndarray, np.ndarray]:
        """Order of the strings by shard, and the shard of each."""
        shard = (np.array(self.keys, np.uint64) % np.uint64(self.shards)).astype(np.int64)
        return np.argsort(shard, kind="stable"), shard


_BLOCK = (
    "block long, shard int, text binary, sizes binary, keys binary, firsts binary, "
    "docs binary, starts binary, ats binary"
)


def _read(shards: int, shared):
    """Rows of _BLOCK: those of the strings of each block, and one of their places."""

    def run(batches):
        table, frequent = shared.value
        blocks = _Blocks(shards)
        for batch in batches:
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if data:
                    blocks.add(doc, data, _units(data, table, frequent))
                if len(blocks.known) > HELD or len(blocks.places) > 4 * HELD:
                    yield _written(blocks)
                    blocks.clear()
        if blocks.known:
            yield _written(blocks)

    return run


def _written(blocks: _Blocks) -> pa.RecordBatch:
    number = blocks.number()
    order, shard = blocks.split()
    texts = list(blocks.known)
    keys, firsts = np.array(blocks.keys, np.uint64), np.array(blocks.firsts, np.int64)
    rows = []
    for own in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
        found = [texts[i] for i in own.tolist()]
        rows.append((
            number, int(shard[own[0]]), zstandard.ZstdCompressor(level=3).compress(b"".join(found)),
            _press(np.array([len(t) for t in found], np.uint32)), _press(keys[own]), _press(firsts[own]),
            None, None, None,
        ))
    # where the strings are, by their place in shard order
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    doc, start, at = np.array(blocks.places, np.int64).T
    places = (_press(np.diff(doc, prepend=0)), _press(start.astype(np.int64)), _press(rank[at].astype(np.uint32)))
    rows.append((number, None, None, None, None, None, *places))
    kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 7)
    names = [c.split()[0] for c in _BLOCK.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def earliest(strings: list[bytes], firsts: np.ndarray) -> list[np.ndarray]:
    """For each string the smallest first at each of its starts among all that share LENGTH bytes."""
    if not strings:
        return []
    sizes = np.array([len(t) for t in strings])
    flat = np.frombuffer(b"\0".join(strings) + b"\0" * 9, np.uint8)
    n = int(sizes.sum()) + len(sizes)
    begin = np.cumsum(np.append(0, sizes[:-1] + 1))
    text = flat[:n].astype(np.int16) + 1
    text[begin + sizes] = 0
    order = suffix_array(text)
    # only starts with LENGTH bytes ahead in their own string
    room = np.repeat(begin + sizes, sizes + 1) - np.arange(n)
    order = order[room[order] >= LENGTH]
    words = np.ndarray((n,), "<u8", flat.tobytes(), 0, (1,))
    live = np.arange(max(len(order) - 1, 0))
    for k in (*range(0, LENGTH - 7, 8), LENGTH - 8):  # adjacent prefixes
        live = live[words[order[live] + k] == words[order[live + 1] + k]]
    new = np.ones(len(order), bool)
    new[live + 1] = False
    first = np.flatnonzero(new)
    out = np.zeros(n, np.int64)
    if len(order):
        low = np.minimum.reduceat(np.repeat(firsts, sizes + 1)[order], first)
        out[order] = np.repeat(low, np.diff(np.append(first, len(order))))
    return [out[b : b + n - LENGTH + 1] for b, n in zip(begin.tolist(), sizes.tolist())]


def _sorted(key, table):
    """(block, shard, runs): for the strings of each block of a shard, in order, runs of starts (end,
    smallest doc_id), the last of each string marked by its end being negative."""
    at: dict[bytes, int] = {}
    keys, firsts, blocks = [], [], []
    for row in table.to_pylist():
        data = zstandard.ZstdDecompressor().decompress(row["text"])
        ends = np.cumsum(_unpress(row["sizes"], np.uint32)).tolist()
        ids = []
        for a, b, k, doc in zip([0, *ends], ends, _unpress(row["keys"], np.uint64).tolist(), _unpress(row["firsts"], np.int64).tolist()):
            text = data[a:b]
            i = at.setdefault(text, len(keys))
            if i == len(keys):
                keys.append(k)
                firsts.append(doc)
            elif doc < firsts[i]:
                firsts[i] = doc
            ids.append(i)
        blocks.append((row["block"], row["shard"], ids))
    texts = list(at)
    low = np.array(firsts, np.int64)
    # a string that is alone under its minimizer shares nothing with others
    _, group, size = np.unique(np.array(keys, np.uint64), return_inverse=True, return_counts=True)
    several = np.flatnonzero(size[group] > 1)
    runs: dict[int, bytes] = {}
    for i, found in zip(several.tolist(), earliest([texts[i] for i in several.tolist()], low[several])):
        cuts = np.flatnonzero(np.diff(found)) + 1
        ends = np.append(cuts, len(found))
        ends[-1] = -ends[-1]
        runs[i] = np.stack([ends, found[np.append(0, cuts)]], 1).astype(np.int64).tobytes()
    for i in np.flatnonzero(size[group] == 1).tolist():
        runs[i] = np.array([LENGTH - 1 - len(texts[i]), low[i]], np.int64).tobytes()
    out = [_press(np.frombuffer(b"".join([runs[i] for i in ids]), np.int64)) for _, _, ids in blocks]
    return pa.table(
        [pa.array([b for b, _, _ in blocks], pa.int64()), pa.array([s for _, s, _ in blocks], pa.int32()), pa.array(out, pa.binary())],
        ["block", "shard", "runs"],
    )


def _covered(batches):
    """(doc_id, spans): bytes of documents whose strings have an earlier document."""
    for batch in batches:
        docs, spans = [], []
        for row in batch.to_pylist():
            doc = np.cumsum(_unpress(row["docs"], np.int64))
            start, at = _unpress(row["starts"], np.int64), _unpress(row["ats"], np.uint32).astype(np.int64)
            runs = np.concatenate([_unpress(x["runs"], np.int64) for x in sorted(row["found"], key=lambda x: x["shard"])]).reshape(-1, 2)
            last = np.flatnonzero(runs[:, 0] < 0)
            head = np.append(0, last[:-1] + 1)
            count = (last - head + 1)[at]
            which = np.repeat(np.arange(len(at)), count)
            run = np.repeat(head[at], count) + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            end = np.abs(runs[run, 0])
            begin = np.where(run == head[at][which], 0, np.abs(runs[run - 1, 0]))
            hit = runs[run, 1] < doc[which]
            which, a, b = which[hit], start[which[hit]] + begin[hit], start[which[hit]] + end[hit] - 1 + LENGTH
            order = np.lexsort((a, doc[which]))
            d, a, b = doc[which][order], a[order], b[order]
            for own in np.split(np.arange(len(d)), np.flatnonzero(np.diff(d)) + 1) if len(d) else []:
                docs.append(int(d[own[0]]))
                spans.append(np.array(merged(zip(a[own].tolist(), b[own].tolist())), np.int64).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(spans, pa.binary())], ["doc_id", "spans"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): for each document with repeats, pairs of ends that cover them, as arrays of
    whole numbers in one or more binary values; they may overlap.

    Rows with a null doc_id neither lose bytes nor take any from others.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.where("doc_id is not null").selectExpr("doc_id", "cast(text as binary) text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    table, frequent, n = repeated_minimizers(docs, size)
    shared = docs.sparkSession.sparkContext.broadcast((table, frequent))
    shards = max(12, n * 64 // BYTES_PER_SHARD)
    blocks = cut(docs.mapInArrow(_read(shards, shared), _BLOCK))
    strings = blocks.where("shard is not null").select("block", "shard", "text", "sizes", "keys", "firsts")
    known = strings.groupBy("shard").applyInArrow(_sorted, "block long, shard int, runs binary")
    # a row for each shard of a block, which holds a bounded number of strings
    known = known.groupBy("block").agg(F.collect_list(F.struct("shard", "runs")).alias("found"))
    places = blocks.where("shard is null").select("block", "docs", "starts", "ats")
    spans = places.join(known, "block").mapInArrow(_covered, "doc_id long, spans binary")
    return spans.groupBy("doc_id").agg(F.collect_list("spans").alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that spans cover."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, last = [], 0
    for a, b in spans:
        out.append(data[last:a])
        last = b
    return b"".join([*out, data[last:]])


@tidied
def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for every row: kept holds the bytes that stay.

    A byte goes if a string of LENGTH bytes over it also starts in a document with a smaller doc_id;
    strings within one document don't count, and all are judged on the texts as they come. Null texts
    are empty. Rows that share a doc_id are one document for this: none takes bytes from another, and
    each loses what any of them has in common with earlier ones.
    """
    spans = cut(repeated_spans(docs))
    rows = docs.selectExpr("doc_id", "cast(coalesce(text, '') as binary) text", "xxhash64(doc_id) h")
    words = filters.filter_words(spans.count())
    rows = filters.tested(rows, "h", words, filters.build(spans.selectExpr("xxhash64(doc_id) h"), words)).drop("h")
    # texts move only for documents that may have spans
    some = rows.where("maybe").drop("maybe").join(spans, "doc_id", "left")
    none = rows.where("not maybe").drop("maybe").withColumn(spans.columns[1], F.lit(None).cast(spans.schema[1].dataType))
    rows = some.unionByName(none)

    def run(batches):
        for batch in batches:
            n, gone, runs, kept = [], [], [], []
            for data, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                pairs = [p for s in found or [] for p in np.frombuffer(s, np.int64).reshape(-1, 2).tolist()]
                own = merged([(a, min(b, len(data))) for a, b in pairs if a < len(data)])
                rest = without(data, own)
                n.append(len(data))
                gone.append(len(data) - len(rest))
                runs.append(len(own))
                kept.append(rest)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (n, gone, runs)), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digests(docs: DataFrame) -> DataFrame:
    """What `remove_repeats` gives, with the sha256 of the bytes that stay."""
    return remove_repeats(docs).selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256) kept_sha256")
