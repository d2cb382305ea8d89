"""Cross-tokenizer alignment: where the tokens of two vocabularies end together.

Both vocabularies cut the same bytes. The ends of both kinds of tokens cut them into elementary
intervals (union1d of the two arrays of ends); searchsorted finds the token of either kind that owns an
interval, so each interval is one overlap of two tokens. Where an interval ends both of its owners, a
group of tokens closes and these two owners are linked. The texts of a batch are laid end to end: every
text ends a token of either kind, so one pass over the intervals serves all of them.

Texts are tokenized once. What later steps need (the numbers of a text and its linked id pairs with
how often each occurs) is written to the folder that all executors share. Pair counts are summed from
there over the whole corpus, and texts are judged by them in a last pass over the same table.
The shorter of two linked tokens is a suffix of the longer one, so the vocabularies alone bound how
many id pairs there are (`most_pairs`), whatever the corpus; that many counts go through the driver.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.lineage import ensure_checkpoint_dir
from docquarry.llm.bpe import _byte_letters
from docquarry.llm.common import narrow

#: Characters of the texts that are aligned at once; a longer text is aligned alone.
PART = 1 << 20
#: The split of byte-level texts into words, a fixed value of that vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class ByteLevel:
    """A byte-level BPE vocabulary of the tokenizers library; special tokens are plain text.

    Ids grow in the order of the merges in such files, so that they are the merges' ranks.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        bytes_of = {c: b for b, c in _byte_letters().items()}
        special = {t["content"] for t in model.get("added_tokens", ())}
        vocabulary = {k: v for k, v in model["model"]["vocab"].items() if k not in special}
        merges = [m if isinstance(m, str) else " ".join(m) for m in model["model"]["merges"]]
        ranks = [vocabulary[m.replace(" ", "")] for m in merges]
        if ranks != sorted(ranks):
            raise ValueError("the ids of this vocabulary don't follow its merges")
        self.bytes = [b""] * (1 + max(vocabulary.values()))
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(map(bytes_of.__getitem__, token))
        self.own = tiktoken.Encoding(
            "own", pat_str=PATTERN, mergeable_ranks={b: i for i, b in enumerate(self.bytes) if b}, special_tokens={}
        )

    def joined(self, ids: np.ndarray) -> bytes:
        return self.own.decode_bytes(ids.tolist())

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [self.own.encode_to_numpy(" " + t, disallowed_special=()).astype(np.int64) for t in texts]


class Pieces:
    """A sentencepiece vocabulary, whose normaliser puts a space before a text."""

    def __init__(self, path: str):
        import sentencepiece

        self.own = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self.own.get_piece_size()):
            piece = self.own.id_to_piece(i)
            code = _BYTE.fullmatch(piece) if self.own.is_byte(i) else None
            self.bytes.append(bytes([int(code[1], 16)]) if code else piece.replace("▁", " ").encode())

    def joined(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in self.own.encode(texts, num_threads=1)]


def most_pairs(a: list[bytes], b: list[bytes]) -> int:
    """How many id pairs can end together: one token's bytes end the other's."""
    few = {False: Counter(a), True: Counter(b)}
    ends = sum(few[True][t[k:]] for t in a for k in range(len(t)))
    return ends + sum(few[False][t[k:]] for t in b for k in range(1, len(t)))


_loaded: dict[tuple[str, str], tuple] = {}


def _aligner(paths: tuple[str, str]) -> Aligner:
    """The aligner of this Python process."""
    if paths not in _loaded:
        _loaded[paths] = Aligner(*paths)
    return _loaded[paths]


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.lengths = [np.array([len(t) for t in v.bytes]) for v in (self.a, self.b)]
        # an id with the mark that follows it: within a side, behind A, behind B, at the text's end; B's ids follow A's
        self.shown = [f"{i}{mark}".encode() for v in (self.a, self.b) for i in range(len(v.bytes)) for mark in (",", "|", ";", "")]
        self.shown_lengths = np.array([len(x) for x in self.shown])

    def tokens(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both kinds; none where the joined bytes of either aren't those of space and text."""
        none = np.zeros(0, np.int64)
        asked = [t for t in texts if t]
        ids = [self.a.ids(asked), self.b.ids(asked)]
        whole = [b" " + t.encode() for t in asked]
        kept = [True] * len(asked)
        for vocabulary, each in zip((self.a, self.b), ids):
            # all texts at once; one by one only where something differs
            if asked and vocabulary.joined(np.concatenate(each)) != b"".join(whole):
                kept = [k and vocabulary.joined(x) == w for k, x, w in zip(kept, each, whole)]
        found = iter(zip(kept, *ids))
        out = []
        for text in texts:
            same, *both = next(found) if text else (False,)
            out.append(tuple(both) if same else (none, none))
        return out

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], list, list]:
        """(numbers, groups_sha256, codes, times) of texts; numbers has the columns n_a, n_b, n_groups,
        n_overlaps and n_products, codes are linked id pairs and times how often each is."""
        tokens = self.tokens(texts)
        of = [np.repeat(np.arange(len(texts)), [len(t[k]) for t in tokens]) for k in (0, 1)]
        ids = [np.concatenate([t[k] for t in tokens]) for k in (0, 1)]
        ends = [np.cumsum(lengths[i]) for lengths, i in zip(self.lengths, ids)]
        cuts = np.union1d(*ends)
        owner = [np.searchsorted(e, cuts) for e in ends]
        shared = (ends[0][owner[0]] == cuts) & (ends[1][owner[1]] == cuts)
        last = [o[shared] for o in owner]  # the tokens that close a group are linked
        text = of[0][last[0]]
        sizes = [np.diff(x, prepend=-1) for x in last]
        count = lambda rows, weights=None: np.bincount(rows, weights, len(texts)).astype(np.int64)
        numbers = np.stack(
            [count(of[0]), count(of[1]), count(text), count(of[0][owner[0]]), count(text, sizes[0] * sizes[1])], 1
        )
        pairs = ids[0][last[0]] * len(self.b.bytes) + ids[1][last[1]]
        space = len(self.a.bytes) * len(self.b.bytes)
        keyed, n = np.unique(text * space + pairs, return_counts=True)
        at = np.searchsorted(keyed, np.arange(len(texts) + 1) * space)
        codes = [keyed[x:y] - k * space for k, (x, y) in enumerate(zip(at[:-1], at[1:]))]
        return numbers, self._digests(ids, last, text, numbers), codes, [n[x:y] for x, y in zip(at[:-1], at[1:])]

    def _digests(self, ids, last, text, numbers) -> list[str]:
        """Lowercase hex of `a1,a2|b1;a3|b2,b3` of each text; empty without tokens."""
        closes = text != np.append(text[1:], -1)
        # every token lies in a group; those of B stand behind those of A of their group
        group = [np.repeat(np.arange(len(text)), np.diff(x, prepend=-1)) for x in last]
        before = [np.append(0, last[1][:-1] + 1)[group[0]], last[0][group[1]] + 1]
        merged = np.empty(len(ids[0]) + len(ids[1]), np.int64)
        for k, mark in ((0, 1), (1, np.where(closes, 3, 2))):
            shown = ids[k] * 4 + 4 * k * len(self.a.bytes)
            shown[last[k]] += mark
            merged[np.arange(len(shown)) + before[k]] = shown
        joined = memoryview(b"".join(map(self.shown.__getitem__, merged.tolist())))
        tokens = np.append(0, np.cumsum(numbers[:, 0] + numbers[:, 1]))
        at = np.append(0, np.cumsum(self.shown_lengths[merged]))[tokens].tolist()
        return [hashlib.sha256(joined[x:y]).hexdigest() if x < y else "" for x, y in zip(at[:-1], at[1:])]


def _parts(texts: list):
    """Runs of the texts of about PART characters."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text or "") > PART:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text or "")
    if held:
        yield held


NUMBERS = ("n_a", "n_b", "n_groups", "n_overlaps", "n_products")


def linked(docs: DataFrame, vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_overlaps, n_products, groups_sha256, codes, times) for every row.

    codes are the id pairs whose tokens end together, as a * (size of B) + b, and times how often each
    does; n_overlaps counts elementary intervals and n_products all pairs within groups. A null or empty
    text, or one that a vocabulary doesn't keep byte for byte, has no tokens.
    """
    paths = vocabularies or default_vocabularies()
    long = ", ".join(f"{n} long" for n in NUMBERS)

    def run(batches):
        aligner = _aligner(paths)
        for batch in batches:
            at = 0
            for part in _parts(batch.column(1).to_pylist()):
                numbers, digests, codes, times = aligner.align(part)
                lists = [
                    pa.ListArray.from_arrays(
                        pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(np.concatenate(x), pa.int64())
                    )
                    for x in (codes, times)
                ]
                columns = [batch.column(0).slice(at, len(part)), *map(pa.array, numbers.T), pa.array(digests, pa.string()), *lists]
                at += len(part)
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *NUMBERS, "groups_sha256", "codes", "times"])

    return narrow(docs, "doc_id", "text").mapInArrow(
        run, f"doc_id long, {long}, groups_sha256 string, codes array<long>, times array<long>"
    )


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(code, n): how often each id pair is linked in all rows. Tasks add up what they read first."""

    def run(batches):
        codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            new, where = np.unique(
                np.concatenate([codes, batch.column(0).flatten().to_numpy(zero_copy_only=False)]), return_inverse=True
            )
            weights = np.concatenate([counts, batch.column(1).flatten().to_numpy(zero_copy_only=False)])
            total = np.zeros(len(new), np.int64)
            np.add.at(total, where, weights)
            codes, counts = new, total
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], ["code", "n"])

    parts = aligned.select("codes", "times").mapInArrow(run, "code long, n long")
    return parts.groupBy("code").agg(F.sum("n").alias("n"))


def alignments(docs: DataFrame, vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_overlaps, n_products)
    for every row of docs.

    A link is a pair of tokens that end at the same byte. n_best counts links whose id pair is the most
    frequent one of its B id over all rows, ties included; count_sum adds up the counts of the pairs.
    Rows without tokens (`linked`) have zeros and an empty groups_sha256. Repeated rows give repeated
    results and count each time; null ids stay. An empty table gives no rows. A text is held whole by
    the task that reads it, whatever its length.
    """
    paths = vocabularies or default_vocabularies()
    spark = docs.sparkSession
    place = f"{ensure_checkpoint_dir(spark)}/aligned-{uuid.uuid4().hex}"
    linked(docs, paths).write.option("compression", "zstd").parquet(place)
    aligned = spark.read.parquet(place)
    # at most most_pairs() rows, which the vocabularies bound
    counted = pair_counts(aligned).toArrow()
    codes, counts = (counted.column(c).to_numpy() for c in ("code", "n"))
    order = np.argsort(codes)
    codes, counts = codes[order], counts[order]
    size = len(_aligner(paths).b.bytes)
    top = np.zeros(size, np.int64)
    np.maximum.at(top, codes % size, counts)
    known = spark.sparkContext.broadcast((codes, counts, counts == top[codes % size]))

    def run(batches):
        codes, counts, best = known.value
        for batch in batches:
            lists, times = batch.column("codes"), batch.column("times").flatten().to_numpy(zero_copy_only=False)
            at = np.searchsorted(codes, lists.flatten().to_numpy(zero_copy_only=False))
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            total = lambda x: np.diff(np.append(0, np.cumsum(x))[np.append(0, ends)])
            columns = [batch.column(n) for n in ("doc_id", *NUMBERS[:3])]
            columns += [pa.array(total(x).astype(np.int64)) for x in (times, times * best[at], times * counts[at])]
            columns += [batch.column(n) for n in ("groups_sha256", *NUMBERS[3:])]
            yield pa.RecordBatch.from_arrays(columns, OUT)

    schema = ", ".join(f"{n} {'string' if n == 'groups_sha256' else 'long'}" for n in OUT)
    return aligned.mapInArrow(run, schema)


OUT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps", "n_products"]
