"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over 16 bytes cuts texts into chunks whose borders depend on the content alone, so a
passage that many documents share gives the same chunks in each. The chunks that repeat most are
found by a count over all documents, encoded once and sent to every task; a task encodes any other
chunk once and keeps it while memory allows. A chunk's border may fall inside a word. Each join is
therefore repaired: the words around it are encoded again, with a word of context on either side,
and the window grows until the context comes out exactly as the chunks have it.

The vocabulary is any file of the tokenizers library that drops white space before its merges, so
that words on either side of white space don't influence each other; `WordEncoder` refuses others.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import narrow

#: Words and chunks that one task keeps, and the longest kept ones in bytes.
MAX_WORDS, MAX_WORD = 900_000, 48
MAX_CHUNKS, MAX_CHUNK = 8_000, 4096
#: Chunks that are encoded once for all tasks; at most SHARED * MAX_CHUNK bytes are sent.
SHARED = 4096
#: A border follows where this many top bits of the hash are zero: chunks of 512 bytes on average.
BORDER_BITS = 9

#: A word of one id, set between the words that are encoded together.
MARK = "\N{GRINNING FACE}"

_SPACES = b" \t\n\v\f\r"
_SPACE = re.compile(rb"[ \t\n\v\f\r]+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def load_tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


#: A word that needs no other rule than lower case: Latin letters, then ASCII marks but ' and <.
_SIMPLE = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*)([!-&(-/:;=-@\[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if chr(b).isprintable() and b not in (32, 160, 173)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class WordEncoder(dict):
    """Ids of words, as bytes of little-endian 32-bit numbers."""

    def __init__(self, path: str):
        super().__init__()
        self.tok = load_tokenizer(path)
        self.letters = _byte_letters()
        self.base: dict[str, bytes] = {}
        self.mark = self.ids(MARK)
        probe = ["the", "'s", "12", "a,b", "\u00e9", "<|endoftext|>"]
        apart = [i for w in probe for i in self.ids(w)]
        if self.ids(" ".join(probe)) != apart or self.ids("\n".join(probe)) != apart:
            raise ValueError("this vocabulary's ids depend on white space")
        # simple words go straight to the merges if that gives the same ids
        simple = ["Hello,", "World.", "\u00c9t\u00e9", "quementeas", "a", "Stra\u00dfe", "\u00f1and\u00fa,", "\u00c0\u00dd\u00ff", "ab***", "|", "x#_$%"]
        self.direct = all(self._simple(w) == self._pack(self.ids(w)) for w in simple)

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _merged(self, piece: str) -> bytes:
        if (found := self.base.get(piece)) is None:
            shown = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
            found = self.base[piece] = self._pack([t.id for t in self.tok.model.tokenize(shown)])
        return found

    def _simple(self, word: str) -> bytes | None:
        m = _SIMPLE.fullmatch(word)
        if not m:
            return None
        return (self._merged(m[1].lower()) if m[1] else b"") + (self._merged(m[2]) if m[2] else b"")

    def learn(self, words) -> None:
        """Encodes the words that aren't known yet, those that aren't simple many in one text with a
        mark between them."""
        if len(self) > MAX_WORDS:
            self.clear()
        if len(self.base) > MAX_WORDS:
            self.base.clear()
        rest = []
        for word in {w for w in words if w not in self}:
            if self.direct and (found := self._simple(word.decode())) is not None:
                self[word] = found
            elif len(self.mark) == 1 and MARK.encode() not in word:
                rest.append(word)
            else:
                self[word] = self[word]
        for at in range(0, len(rest), 256):
            part = rest[at : at + 256]
            text = f" {MARK} ".join(w.decode() for w in part)
            ids = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(ids == self.mark[0]).tolist()
            data = ids.tobytes()
            for word, a, b in zip(part, [-1, *ends], [*ends, len(ids)]):
                self[word] = data[4 * a + 4 : 4 * b]

    def __missing__(self, word: bytes) -> bytes:
        return self._pack(self.ids(word.decode()))

    def encode(self, words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, words)), "<u4")

    def encode_texts(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of whole texts: white space never reaches the merges."""
        split = [t.split() for t in texts]
        self.learn(w for w in set(chain.from_iterable(split)) if len(w) <= MAX_WORD)
        return [self.encode(words) for words in split]


_encoders: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """The encoder of this Python process; what it knows serves later tasks too."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def borders(data: bytes) -> np.ndarray:
    """Ends of the chunks of data. Every chunk but the only one of a text has white space in it."""
    n = len(data)
    if n < 32:
        return np.array([n])
    low = np.ndarray((n - 15,), "<u8", data, 0, (1,))
    high = np.ndarray((n - 15,), "<u8", data, 8, (1,))
    h = (low * np.uint64(0x9E3779B97F4A7C15)) ^ (high * np.uint64(0xC2B2AE3D27D4EB4F))
    h *= np.uint64(0x165667B19E3779F9)
    ends = np.flatnonzero(h >> np.uint64(64 - BORDER_BITS) == 0) + 16
    flat = np.frombuffer(data, np.uint8)
    ends = ends[ends < n]
    ends = np.append(ends[flat[ends] & 0xC0 != 0x80], n)  # not inside a character
    space = (flat == 32) | ((flat >= 9) & (flat <= 13))
    seen = np.concatenate([[0], np.cumsum(space)])
    keep, last = [], 0
    for end in ends.tolist():
        if seen[end] > seen[last]:
            keep.append(end)
            last = end
    if last < n:
        if keep:
            keep[-1] = n
        else:
            keep.append(n)
    return np.array(keep)


def chunks(data: bytes) -> list[bytes]:
    out, last = [], 0
    for end in borders(data).tolist():
        out.append(data[last:end])
        last = end
    return out


def split_chunk(chunk: bytes) -> tuple[bytes, list[bytes], bytes]:
    """First word, whole words, last word; the outer two are empty where white space is there."""
    first = _SPACE.search(chunk)
    if not first:
        return chunk, [], b""
    words = chunk.split()
    head = words.pop(0) if chunk[0] not in _SPACES else b""
    tail = words.pop() if words and chunk[-1] not in _SPACES else b""
    return head, words, tail


def _counted(batches):
    """(hash, n, chunk): the chunks of a task; the text only of those that repeat in it."""
    seen: dict[int, int] = {}
    kept: dict[int, bytes] = {}

    def out():
        table = pa.RecordBatch.from_arrays(
            [
                pa.array(np.fromiter(seen, np.uint64, len(seen)).view(np.int64)),
                pa.array(list(seen.values()), pa.int64()),
                pa.array([kept.get(k) for k in seen], pa.binary()),
            ],
            ["hash", "n", "chunk"],
        )
        seen.clear()
        kept.clear()
        return table

    for batch in batches:
        for text in batch.column(0).to_pylist():
            for chunk in chunks(text or b""):
                key = xxhash.xxh3_64_intdigest(chunk)
                seen[key] = n = seen.get(key, 0) + 1
                if n == 2 and len(chunk) <= MAX_CHUNK:
                    kept[key] = chunk
        if len(seen) > 200_000:
            yield out()
    yield out()


def shared_chunks(docs: DataFrame, most: int = SHARED) -> list[bytes]:
    """The chunks that repeat most over all texts; at most `most` of at most MAX_CHUNK bytes."""
    found = (
        narrow(docs, "cast(text as binary) text")
        .mapInArrow(_counted, "hash long, n long, chunk binary")
        .groupBy("hash")
        .agg(F.sum("n").alias("n"), F.max("chunk").alias("chunk"))
        .where("chunk is not null")
    )
    rows = found.orderBy(F.desc("n"), "hash").limit(most).select("chunk").collect()
    return [bytes(r.chunk) for r in rows]


class ChunkEncoder:
    """Encodes whole texts chunk by chunk."""

    def __init__(self, path: str, shared: list[bytes]):
        self.words = word_encoder(path)
        self.own: dict[bytes, tuple] = {}
        self.shared: dict[bytes, tuple] = {}
        for chunk in shared:
            self.shared[chunk] = self._chunk(chunk)

    def _chunk(self, chunk: bytes) -> tuple:
        head, words, tail = split_chunk(chunk)
        first, last = (words[0], words[-1]) if words else (b"", b"")
        return head, first, self.words.encode(words), last, tail

    def _known(self, chunk: bytes) -> tuple:
        found = self.shared.get(chunk) or self.own.get(chunk)
        if not found:
            found = self._chunk(chunk)
            if len(chunk) <= MAX_CHUNK:
                if len(self.own) >= MAX_CHUNKS:
                    self.own.clear()
                self.own[chunk] = found
        return found

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        cut_up = [chunks(t) for t in texts]
        new = {c for doc in cut_up for c in doc if c not in self.shared and c not in self.own}
        self.words.learn(w for c in new for w in c.split() if len(w) <= MAX_WORD)
        docs = [[self._known(c) for c in doc] for doc in cut_up]
        # the words that meet at each join, with a word of context on either side
        windows, where = [], []
        for k, doc in enumerate(docs):
            for i in range(len(doc) + 1):
                left = doc[i - 1] if i else (b"",) * 5
                right = doc[i] if i < len(doc) else (b"",) * 5
                if word := left[4] + right[0]:
                    windows.append((left[3], word, right[1]))
                    where.append((k, i))
        seams = dict(zip(where, self._repair(windows)))
        out = []
        for k, doc in enumerate(docs):
            if any(seams.get((k, i), True) is None for i in range(len(doc) + 1)):
                out.append(np.array(self.words.ids(texts[k].decode()), "<u4"))
                continue
            parts = []
            for i in range(len(doc) + 1):
                if (seam := seams.get((k, i))) is not None:
                    parts.append(seam)
                if i < len(doc):
                    parts.append(doc[i][2])
            out.append(np.concatenate(parts) if parts else np.zeros(0, "<u4"))
        return out

    def _repair(self, windows: list[tuple[bytes, bytes, bytes]]) -> list:
        """Ids of the word at each join; None where the context doesn't agree, however far it goes
        within the two chunks: the whole text is then encoded anew."""
        out = []
        for at in range(0, len(windows), 4096):
            part = windows[at : at + 4096]
            text = [b" ".join(filter(None, w)).decode() for w in part]
            for (left, _, right), x in zip(part, self.words.tok.encode_batch(text, add_special_tokens=False)):
                ids = np.array(x.ids, "<u4")
                a, b = (np.frombuffer(self.words[w], "<u4") if w else ids[:0] for w in (left, right))
                agrees = np.array_equal(ids[: len(a)], a) and np.array_equal(ids[len(ids) - len(b) :], b)
                out.append(ids[len(a) : len(ids) - len(b)] if agrees else None)
        return out


def _digests(path: str, shared: list[bytes]):
    def run(batches):
        encoder = ChunkEncoder(path, shared)
        tok = encoder.words.tok
        size = tok.get_vocab_size(with_added_tokens=True)
        decimal = [str(i).encode() for i in range(size)]
        token = [(tok.id_to_token(i) or "").encode() for i in range(size)]
        plain = tok.decoder is None
        for batch in batches:
            rows = []
            for ids in encoder.encode([t or b"" for t in batch.column(1).to_pylist()]):
                ids = ids.tolist()
                if plain:  # without a decoder of its own, decode() joins the tokens by a space
                    text = b" ".join(map(token.__getitem__, ids))
                else:
                    text = tok.decode(ids, skip_special_tokens=False).encode()
                joined = b" ".join(map(decimal.__getitem__, ids))
                rows.append((len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(text).hexdigest()))
            n, a, b = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded) for every row: its text's ids and what they decode to.

    Null and empty texts have no ids. Repeated rows give repeated results.
    """
    path = vocabulary or default_vocabulary()
    shared = shared_chunks(docs)

    def run(batches):
        encoder = ChunkEncoder(path, shared)
        for batch in batches:
            ids = [x.tolist() for x in encoder.encode([t or b"" for t in batch.column(1).to_pylist()])]
            text = [encoder.words.tok.decode(x, skip_special_tokens=False) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(text, pa.string())],
                ["doc_id", "ids", "decoded"],
            )

    return narrow(docs, "doc_id", "cast(text as binary) text").mapInArrow(
        run, "doc_id long, ids array<int>, decoded string"
    )


def digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what `encode` gives, without the texts."""
    path = vocabulary or default_vocabulary()
    run = _digests(path, shared_chunks(docs))
    return narrow(docs, "doc_id", "cast(text as binary) text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
