"""Best-fit packing of documents into sequences by bin completion.

Only the counts of pieces by length, at most `capacity` numbers, come to the driver. There a
branch-and-bound search completes the bin of the largest remaining piece by undominated fillings,
each applied to as many bins as the counts allow. Best-fit packings of what is left are the
incumbents, and a branch ends where its waste can't beat them. The search gives patterns; every piece
then finds its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.lineage import cut
from docquarry.llm.bpe import default_vocabulary, word_encoder
from docquarry.llm.common import narrow

CAPACITY = 2048
END_ID = 0
#: Pieces of one length that are ranked within one group.
GROUP_ROWS = 20_000
#: Nodes of the search, fillings tried at a node, and steps to find them.
MAX_NODES, MAX_FILLINGS, MAX_STEPS = 1200, 4, 400

Pattern = tuple[tuple[int, int], ...]  # (length, how many), longest first


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing on counts: patterns and how many bins have them."""
    open_bins: dict[int, list[list]] = {}  # room -> [pattern, bins]
    rooms: list[int] = []

    def put(pattern: Pattern, room: int, n: int) -> None:
        if room not in open_bins:
            open_bins[room] = []
            insort(rooms, room)
        open_bins[room].append([pattern, n])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                fit = capacity // length
                full, rest = divmod(left, fit)
                if full:
                    put(((length, fit),), capacity - fit * length, full)
                if rest:
                    put(((length, rest),), capacity - rest * length, 1)
                break
            room = rooms[at]
            pattern, bins = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room]
                rooms.pop(at)
            fit = room // length
            full, rest = divmod(min(left, bins * fit), fit)
            left -= full * fit + rest
            if full:
                put((*pattern, (length, fit)), room - fit * length, full)
            if rest:
                put((*pattern, (length, rest)), room - rest * length, 1)
            if bins > full + bool(rest):
                put(pattern, room, bins - full - bool(rest))
    return [(p, n) for found in open_bins.values() for p, n in found]


def _dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the items of b fit into the items of a, taken as bins."""
    if not b:
        return True
    tried = set()
    for i, room in enumerate(a):
        if room >= b[0] and room not in tried:
            tried.add(room)
            if _dominates((*a[:i], room - b[0], *a[i + 1 :]), b[1:]):
                return True
    return False


def fillings(counts: dict[int, int], lengths: list[int], room: int) -> list[tuple[int, ...]]:
    """Undominated sets of pieces for that room, least waste first; lengths ascend."""
    found: list[tuple[int, tuple[int, ...]]] = []
    steps = 0

    def search(room: int, top: int, chosen: tuple[int, ...]) -> None:
        nonlocal steps
        at = bisect_right(lengths, min(room, top)) - 1
        if at < 0:
            found.append((room, chosen))
            return
        while at >= 0 and steps < MAX_STEPS:
            steps += 1
            length = lengths[at]
            if chosen.count(length) < counts[length]:
                search(room - length, length, (*chosen, length))
                if length == room:
                    return  # it dominates what else fits here
            at -= 1
            if len(found) > 24 and found[-1][0] == 0:
                return

    search(room, room, ())
    kept: list[tuple[int, ...]] = []
    for _, new in sorted(set(found), key=lambda x: (x[0], len(x[1]))):
        if not any(len(new) <= 8 and _dominates(old, new) for old in kept):
            kept.append(new)
        if len(kept) == MAX_FILLINGS:
            break
    return kept


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Patterns for all pieces in as few bins as the search finds."""
    counts = {k: n for k, n in counts.items() if n and k < capacity}
    best = best_fit(counts, capacity)
    fewest = sum(n for _, n in best)
    volume = sum(k * n for k, n in counts.items())
    bound = max(-(-volume // capacity), sum(n for k, n in counts.items() if 2 * k > capacity))
    nodes = 0
    stack = [(counts, [], 0)]
    while stack and fewest > bound and nodes < MAX_NODES:
        counts, made, used = stack.pop()
        nodes += 1
        volume = sum(k * n for k, n in counts.items())
        if used - (-volume // capacity) >= fewest:
            continue  # the waste so far is too much
        rest = best_fit(counts, capacity)
        if (total := used + sum(n for _, n in rest)) < fewest:
            best, fewest = made + rest, total
        if not counts:
            continue
        lengths = sorted(counts)
        largest = lengths[-1]
        branches = []
        fewer = counts | {largest: counts[largest] - 1}
        for filling in fillings(fewer, lengths, capacity - largest):
            need: dict[int, int] = {}
            for length in (largest, *filling):
                need[length] = need.get(length, 0) + 1
            times = min(counts[k] // n for k, n in need.items())
            after = {k: n - times * need.get(k, 0) for k, n in counts.items()}
            branches.append(
                ({k: n for k, n in after.items() if n}, [*made, (tuple(sorted(need.items(), reverse=True)), times)], used + times)
            )
        stack.extend(reversed(branches))
    return best


def slots(patterns: list[tuple[Pattern, int]]) -> dict[int, np.ndarray]:
    """For each length, ascending by first rank: first rank, pieces in a bin, first bin, offset."""
    out: dict[int, list] = {}
    ranks: dict[int, int] = {}
    first = 0
    for pattern, bins in patterns:
        offset = 0
        for length, n in pattern:
            rank = ranks.get(length, 0)
            out.setdefault(length, []).append((rank, n, first, offset))
            ranks[length] = rank + n * bins
            offset += n * length
        first += bins
    return {k: np.array(v, np.int64) for k, v in out.items()}


def _pieces(path: str, capacity: int):
    def run(batches):
        encoder = word_encoder(path)
        end = np.array([END_ID], "<u4")
        for batch in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for k, ids in enumerate(encoder.encode_texts([t or b"" for t in batch.column(1).to_pylist()])):
                ids = np.concatenate([ids, end])
                for p, first in enumerate(range(0, len(ids), capacity)):
                    part = ids[first : first + capacity]
                    at.append(k)
                    piece.append(p)
                    start.append(first)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at, pa.int64())),
                    pa.array(piece, pa.int32()),
                    *(pa.array(x, pa.int64()) for x in (start, length, crc)),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row's ids and the end id behind them."""
    return narrow(docs, "doc_id", "cast(text as binary) text").mapInArrow(
        _pieces(vocabulary or default_vocabulary(), capacity),
        "doc_id long, piece int, start long, length long, ids_crc32 long",
    )


def _placed(table: dict[int, np.ndarray]):
    def run(batches):
        for batch in batches:
            length = batch.column(3).to_numpy()
            rank = batch.column(5).to_numpy()
            bins, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length).tolist():
                own = np.flatnonzero(length == k)
                t = table[k]
                t = t[np.searchsorted(t[:, 0], rank[own], "right") - 1]
                turn = rank[own] - t[:, 0]
                bins[own] = t[:, 2] + turn // t[:, 1]
                offset[own] = t[:, 3] + turn % t[:, 1] * k
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(bins), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece of every row of docs, with its sequence and its place there.

    Null texts count as empty and give one piece, the end id. Repeated rows are packed each. Texts of
    more than `capacity` ids are cut into pieces of that length; the last may be shorter. An empty
    table gives no rows.
    """
    parts = cut(pieces(docs, vocabulary, capacity))
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    found = bin_completion(counts, capacity)
    if counts.get(capacity):
        found = [*found, (((capacity, 1),), counts[capacity])]
    table = slots(found)
    groups = max(16, sum(counts.values()) // GROUP_ROWS)
    parts = parts.withColumn("grp", F.expr(f"pmod(xxhash64(doc_id, piece), {groups})"))
    sizes = parts.groupBy("length", "grp").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "grp", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "grp").orderBy("doc_id", "piece")
    ranked = parts.withColumn("rank", F.row_number().over(order)).join(sizes, ["length", "grp"])
    ranked = ranked.selectExpr("doc_id", "piece", "start", "length", "ids_crc32", "before + rank - 1 rank")
    return ranked.mapInArrow(
        _placed(table),
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
