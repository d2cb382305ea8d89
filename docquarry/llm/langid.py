"""Language identification by bit-sliced Bloom filters over character n-grams.

One filter serves all languages: every slot holds a bit for each, so that the AND of an n-gram's
slots is the set of languages that have it. A text's n-grams are looked up, the bits are counted by
language, the counts are corrected for the filter's false positives, and the largest share decides.

An n-gram belongs to a language if it occurs in two of its training texts at least, and in a share of
them that is no less than RELATIVE of the largest share among all languages; what texts of several
languages quote from each other thus counts for the one it is usual in.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import bounded_batches, narrow

GRAM = 3
#: Slots of the filter, hash functions, and most languages: 8 bytes for each slot and 64 languages.
SLOTS, HASHES, MAX_LANGS = 1 << 20, 2, 256
RELATIVE = 0.2
#: A text is read in parts of this many characters.
PART = 1 << 20

_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Whether a code point is a letter."""
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x30000)]))
    return _letters[0]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def grams(text: str) -> np.ndarray:
    """Hashes of the n-grams of a text in lower case; what isn't a letter counts as a blank.

    Runs of blanks count as one, and every text has one at both ends.
    """
    table, out = _letter_table(), []
    for at in range(0, max(len(text), 1), PART):
        code = np.frombuffer(text[at : at + PART + GRAM].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = table[np.minimum(code, len(table) - 1)]
        code = np.where(letter, code, 32).astype(np.uint64)
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        code = np.concatenate([[32], code[keep], [32]]).astype(np.uint64)
        n = len(code) - GRAM + 1
        if n > 0:
            h = np.zeros(n, np.uint64)
            for i in range(GRAM):
                h += code[i : i + n] * _MULT[i]
                h ^= h >> np.uint64(29)
            h *= _MULT[3]
            out.append(h ^ (h >> np.uint64(32)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _seen(batches):
    """(lang, gram, n): in how many texts of a batch a language has an n-gram; gram 0 counts texts."""
    for batch in batches:
        by: dict[str, list] = {}
        for lang, text in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
            by.setdefault(lang, []).append(np.unique(grams(text or "")))
        for lang, found in by.items():
            h, n = np.unique(np.concatenate([np.zeros(len(found), np.uint64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))],
                ["lang", "gram", "n"],
            )


def slots_of(h: np.ndarray) -> list[np.ndarray]:
    return [((h >> np.uint64(20 * i)) & np.uint64(SLOTS - 1)).astype(np.int64) for i in range(HASHES)]


def learn(train: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, filter (slots x words of 64 bits), and the false positive rate of each language.

    train has lang and text. Counting, choosing and folding into slots run as Spark jobs; SLOTS words
    for every 64 languages come to the driver at most.
    """
    seen = narrow(train.where("lang is not null"), "lang", "text").mapInArrow(_seen, "lang string, gram long, n long")
    seen = seen.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    texts = seen.where("gram = 0").select("lang", F.col("n").alias("texts"))
    langs = sorted((r.lang, r.texts) for r in texts.orderBy(F.desc("texts"), "lang").limit(MAX_LANGS).collect())
    names = [lang for lang, _ in langs]
    words = max(1, -(-len(names) // 64))
    table = np.zeros((SLOTS, words), np.uint64)
    if names:
        order = train.sparkSession.createDataFrame(
            [(lang, k, float(n)) for k, (lang, n) in enumerate(langs)], "lang string, k int, texts double"
        )
        share = seen.where("gram <> 0").join(F.broadcast(order), "lang").withColumn("share", F.expr("n / texts"))
        top = share.groupBy("gram").agg(F.max("share").alias("top"))
        kept = share.where("n >= 2").join(top, "gram").where(F.col("share") >= RELATIVE * F.col("top"))
        slot = ", ".join(f"shiftright(gram, {20 * i}) & {SLOTS - 1}L" for i in range(HASHES))
        bits = (
            kept.selectExpr("cast(floor(k / 64) as int) word", "shiftleft(1L, k % 64) bit", f"explode(array({slot})) slot")
            .groupBy("slot", "word")
            .agg(F.expr("bit_or(bit) bits"))
        )
        found = bits.toPandas()
        table[found["slot"].to_numpy(), found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    fill = np.array([(table[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)).mean() for k in range(len(names))])
    return names, table, fill**HASHES


def decide(text: str | None, names: list[str], table: np.ndarray, false: np.ndarray) -> tuple[str, float]:
    """Language and its share of the corrected counts; `und` without a letter or a language."""
    if not text or not names or not has_letter(text):
        return "und", 0.0
    h = grams(text)
    first, *others = slots_of(h)
    masks = table[first]
    for other in others:
        masks = masks & table[other]
    hits = np.array([np.count_nonzero(masks[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)) for k in range(len(names))])
    real = np.maximum(hits - len(h) * false, 0) / np.maximum(1 - false, 1e-9)
    best = int(real.argmax())
    return names[best], float(min(1.0, real[best] / real.sum())) if real.sum() else 0.0


def languages(docs: DataFrame, train: DataFrame) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of docs, from a filter learnt on train (lang, text).

    Ties go to the language that comes first by name. Without training rows every row is `und`.
    """
    names, table, false = learn(train)
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((names, table, false))

    def run(batches):
        names, table, false = shared.value
        for batch in batches:
            rows = [decide(t, names, table, false) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return narrow(docs, "doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


HELD_OUT = "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, false)"


def held_out_languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learnt from the rows that aren't held out.

    A row is held out if the crc32 of its doc_id as text leaves 1 when divided by 3. Null texts and
    texts without a letter are `und`. Repeated rows give repeated results.
    """
    found = languages(docs, docs.where(f"not ({HELD_OUT})"))
    return found.selectExpr("doc_id", f"{HELD_OUT} held_out", "lang_pred", "score")
