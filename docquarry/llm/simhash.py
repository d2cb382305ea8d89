"""SimHash near-duplicates through deletion variants of fingerprint segments.

Two 64-bit fingerprints that differ in at most two bits agree, in at least one of their two 32-bit
halves, in all bits but one. Every fingerprint is therefore indexed under 64 keys: each half with one
bit as wildcard. An equality join on the keys gives the candidates, which are then verified.

Exact copies of a fingerprint are folded before indexing. A key that holds two fingerprints is
verified in place; up to MAX_BUCKET fingerprints are compared inside one task, which returns a
spanning forest and not all pairs. The fingerprints of fuller buckets are indexed again under all
two-wildcard keys; those buckets hold at most four fingerprints, so the work stays linear.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.lineage import cut, tidied
from docquarry.llm.common import narrow, word_blocks
from docquarry.operators.components import connected_components
from docquarry.operators.skew import spread_join

SHINGLE = 3
SEED = 42
MAX_BITS = 2
#: Most distinct fingerprints that one task compares with each other (32 kB).
MAX_BUCKET = 4096

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_LANES = np.arange(8, dtype=np.int64) * 256


def fingerprint(data: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned fingerprint of a UTF-8 text; 0 where it has no word."""
    ones, total, tail = np.zeros(64, np.int64), 0, []
    for words in word_blocks(data.lower()):
        words = tail + words
        if len(words) >= shingle:
            rows = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
            n = len(words) - shingle + 1
            h = np.fromiter(map(xxhash.xxh64_intdigest, rows, repeat(seed)), np.uint64, n)
            lanes = h.view(np.uint8).reshape(n, 8) + _LANES
            ones += (np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
            total += n
        tail = words[-(shingle - 1) :] if shingle > 1 else []
    if not total and tail:
        return xxhash.xxh64_intdigest(b" ".join(tail), seed)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > total).tolist()))


def _fingerprints(batches):
    for batch in batches:
        values = [fingerprint(t or b"") for t in batch.column(1).to_pylist()]
        out = np.array(values, np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["doc_id", "fp"])


def _row_fingerprints(batches):
    for batch in batches:
        for found in _fingerprints([batch]):
            yield pa.RecordBatch.from_arrays([*found.columns, batch.column(2)], ["doc_id", "fp", "text_hash"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for every row; fp holds the 64 bits in a long. Null texts count as empty."""
    return narrow(docs, "doc_id", "cast(text as binary) text").mapInArrow(
        _fingerprints, "doc_id long, fp long"
    )


def _forests(batches):
    """Spanning forests of the links within each bucket."""
    for batch in batches:
        src, dst = [], []
        for members in batch.column(0).to_pylist():
            # unsigned: bits are counted in absolute values
            rest = np.unique(np.array(members, np.int64)).view(np.uint64)
            while len(rest) > 1:
                queue, rest = [rest[0]], rest[1:]
                root = queue[0]
                while queue and len(rest):
                    near = np.bitwise_count(rest ^ queue.pop()) <= MAX_BITS
                    if near.any():
                        found, rest = rest[near], rest[~near]
                        queue.extend(found)
                        src.extend(repeat(int(root.astype(np.int64)), len(found)))
                        dst.extend(found.view(np.int64).tolist())
        yield pa.RecordBatch.from_arrays(
            [pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"]
        )


def _one_wildcard(prints: DataFrame) -> DataFrame:
    """(key, fp): the number of the wildcard bit, and its half without that bit."""
    half = "shiftrightunsigned(fp, if(p < 32, 0, 32)) & 4294967295L"
    return prints.selectExpr("fp", "explode(sequence(0, 63)) p").selectExpr(
        f"(({half}) & ~shiftleft(1L, p % 32)) | shiftleft(cast(p as bigint), 32) key", "fp"
    )


def _two_wildcards(prints: DataFrame) -> DataFrame:
    """Links between fingerprints that are equal but for two given bits, for all pairs of bits."""
    keyed = (
        prints.selectExpr("fp", "explode(sequence(0, 62)) p")
        .selectExpr("fp", "p", "explode(sequence(p + 1, 63)) q")
        .selectExpr("fp & ~(shiftleft(1L, p) | shiftleft(1L, q)) rest", "p * 64 + q mask", "fp")
    )
    found = keyed.groupBy("rest", "mask").agg(F.collect_set("fp").alias("fps")).where("size(fps) > 1")
    return found.selectExpr("array_min(fps) src", "explode(fps) dst").where("src <> dst")


def links(prints: DataFrame, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Links (src, dst) that connect all distinct fingerprints of prints at MAX_BITS or fewer bits.

    It leaves out a link only where others already connect its two ends.
    """
    keyed = _one_wildcard(prints)
    buckets = cut(
        keyed.groupBy("key")
        .agg(F.count("*").alias("n"), F.min("fp").alias("src"), F.max("fp").alias("dst"))
        .where("n > 1")
    )
    pairs = buckets.where(f"n = 2 and bit_count(src ^ dst) <= {MAX_BITS}").select("src", "dst")
    members = keyed.join(buckets.where("n > 2").select("key", "n"), "key")
    middle = (
        members.where(F.col("n") <= max_bucket)
        .groupBy("key")
        .agg(F.collect_list("fp").alias("fps"))
        .select("fps")
        .mapInArrow(_forests, "src long, dst long")
    )
    out = pairs.unionByName(middle)
    if buckets.where(F.col("n") > max_bucket).limit(1).count():
        out = out.unionByName(
            _two_wildcards(members.where(F.col("n") > max_bucket).select("fp").distinct())
        )
    return out.distinct()


@tidied
def near_duplicates(docs: DataFrame, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    Null and empty texts have fingerprint zero and link like others. component_id is the smallest
    doc_id that links reach; nulls among the ids don't count, so it is null where a component has no
    other. Repeated rows give repeated results; an empty table gives none.
    """
    prints = cut(fingerprints(docs))
    least = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = connected_components(links(least.select("fp"), max_bucket))
    linked = least.join(found.withColumnRenamed("node", "fp"), "fp")
    named = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
    linked = linked.join(named, "component").select("fp", "component_id")
    labels = least.join(linked, "fp", "left").select(
        "fp", F.coalesce("component_id", "rep").alias("component_id")
    )
    return spread_join(prints, labels, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


@tidied
def keep_representatives(docs: DataFrame) -> DataFrame:
    """One row of docs for each near-duplicate component: that of the smallest doc_id, nulls last.

    Rows are told apart by doc_id and a 64-bit hash of the text, so rows without an id, or of one id
    with different texts, go only where another row of their component stays.
    """
    keyed = narrow(docs, "doc_id", "cast(text as binary) text", "xxhash64(text) text_hash")
    prints = cut(keyed.mapInArrow(_row_fingerprints, "doc_id long, fp long, text_hash long"))
    row = F.struct(F.expr("doc_id is null no_id"), "doc_id", "text_hash")
    least = cut(prints.groupBy("fp").agg(F.min(row).alias("first")))
    found = connected_components(links(least.select("fp"))).withColumnRenamed("node", "fp")
    named = least.join(found, "fp", "left").groupBy(F.coalesce("component", "fp").alias("component"))
    kept = named.agg(F.min("first").alias("first")).selectExpr("first.doc_id _id", "first.text_hash _hash")
    # a name of its own, whatever the columns of docs are called
    own = "_text_hash"
    while own in docs.columns:
        own += "_"
    rows = docs.withColumn(own, F.xxhash64("text"))
    same = rows[own].eqNullSafe(kept["_hash"]) & rows["doc_id"].eqNullSafe(kept["_id"])
    return rows.join(kept, same, "left_semi").dropDuplicates(["doc_id", own]).drop(own)
