"""Personal data by exact patterns, and by a conditional random field over word shapes.

The base patterns find e-mail addresses, IPv4 addresses, card numbers and phone numbers. The field
reads the surroundings of every digit, `@` and bracketed "at" of the whole text, cut into words, and
adds what the patterns don't know, such as phone numbers without a country code or addresses whose
signs are spelled out. It is trained on the labelled table below, in a second, on the driver; its
weights go to the tasks. Base spans always stay; a span of the field that touches one is left out.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import bounded_batches, narrow
from docquarry.llm.crf import ChainCRF

KINDS = ("email", "ip", "card", "phone")

# The base patterns, with possessive repeats and a look-behind where they change no match but keep
# the time linear in long runs.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return total % 10 == 0


def ip_valid(text: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in text.split("."))


def card_valid(text: str) -> bool:
    digits = _NOT_DIGIT.sub("", text)
    return 14 <= len(digits) <= 19 and luhn(digits)


def phone_valid(text: str) -> bool:
    return 10 <= len(_NOT_DIGIT.sub("", text)) <= 15


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by start and then by kind; ends exclusive, in code points."""
    out: list[Span] = []
    if "@" in text:
        end = 0
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                end = m.end()
                out.append(("email", start, end))
    for kind, pattern, valid in (("ip", _IP, ip_valid), ("card", _CARD, card_valid), ("phone", _PHONE, phone_valid)):
        if kind == "phone" and "+" not in text:
            continue
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if valid(m.group())]
    return in_order(out)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# --- word-shape features

_SIGNAL = re.compile(r"[0-9@]+|[\[({<](?:at|AT|At)[\])}>]")
_WORD = re.compile(r"\S+")
_EDGE = re.compile(r"^[^\w+(\[]+|[^\w)\]]+$")
#: Characters on each side of a signal that the field reads, and most words in one sequence.
AROUND, MAX_WORDS = 40, 64


def shape(word: str) -> str:
    out = []
    for c in word[:40]:
        kind = "d" if c in "0123456789" else "X" if c.isupper() else "x" if c.isalpha() else c if c.isascii() else "?"
        if kind in "Xx" and out and out[-1] == kind:
            continue
        out.append(kind)
    return re.sub(r"d{5,}", lambda m: "d+", "".join(out))


@lru_cache(maxsize=50_000)
def _own(word: str) -> tuple[str, ...]:
    core = _EDGE.sub("", word)
    digits = _NOT_DIGIT.sub("", core)
    form = shape(core)
    out = ["s=" + form, f"n={min(len(digits), 20)}", f"c={re.sub(r'd+', 'd', form)}"]
    if core and core[0] in "+([":
        out.append("first=" + core[0])
    if core.isalpha():
        out.append("word=" + core.lower()[:12])
    if 14 <= len(digits) <= 19:
        out.append(f"luhn={luhn(digits)}")
    if core.count(":") >= 3 and re.fullmatch(r"[0-9A-Fa-f:]+", core):
        out.append("colons")
    return tuple(out)


def features(words: list[str]) -> list[list[str]]:
    own = [_own(w) for w in words]
    out = []
    for t, mine in enumerate(own):
        before, after = own[t - 1] if t else ("s=^",), own[t + 1] if t + 1 < len(own) else ("s=$",)
        out.append(["bias", *mine, *("-" + f for f in before), *("+" + f for f in after), f"{before[0]}|{mine[0]}", f"{mine[0]}|{after[0]}"])
    return out


# --- the labelled table: spans in braces; 9 stands for a digit, Q for a short word, B for a number up
# to 255, L and N for the digits of a number that passes the card check or doesn't; the rest is text.
# Rows without braces hold nothing personal.

TABLE = """\
write to {email:Q@Q.com} or call
mail {email:Q.Q@Q.example.org} , thanks
Q Q {email:Q [at] Q [dot] com} Q Q
Q {email:Q (at) Q.org} Q
contact {email:Q.Q [at] Q.net} for Q
reach me : {email:Q [at] Q [dot] org} .
Q {email:Q99@Q9.example.com} Q Q
Q Q {email:Q(at)Q.com} Q
Q {email:Q[at]Q.org} Q Q
Q Q {ip:B.B.B.B} Q Q
host {ip:B.B.B.B} is down
from {ip:B.B.B.B}:9999 Q Q
server {ip:9999:Q9::99:9Q} Q Q
Q {ip:Q9QQ:9::Q9:9:9} Q
card {card:LLLLLLLLLLLLLLLL} Q Q
Q Q {card:LLLLLLLLLLLLLLLL} Q
pay with {card:LLLL LLLL LLLL LLLL} now
card {card:LLLL-LLLL-LLLL-LLLL} Q
card {card:LLLL.LLLL.LLLL.LLLL} Q
Q {card:LLLL.LLLL.LLLL.LLLL} Q Q
Q Q {phone:+9 (999) 999-9999} Q Q
call {phone:+99 999 999 9999} today
tel {phone:(999) 999-9999} Q
phone {phone:(999) 999-9999} or Q
Q {phone:(999) 999-9999} Q Q
call {phone:999-999-9999} Q Q
tel : {phone:999.999.9999} , Q
Q Q {phone:999-999-9999} Q
phone {phone:999 999 9999} Q
fax {phone:999 999 9999} Q Q
Q 9 Q Q
Q 99 Q 99 Q
version 9 of Q
licensed under Q version 9.9 .
in 9999 Q Q
since 9999-99-99 Q Q
99/99/9999 Q Q
at 99:99 Q Q
at 99:99:99 Q
Q 9999 Q 9999 Q
chapter 99 , page 999
Q 999 999 Q Q
Q 9999-9999 Q
Q 99999 Q Q
Q 999999 999999 Q
id 9999999999 Q
Q 9999999999999999 Q Q
Q Q NNNNNNNNNNNNNNNN Q Q
card NNNNNNNNNNNNNNNN Q
Q NNNNNNNNNNNNNN Q
Q NNNN NNNN NNNN NNNN Q
Q 999.999.9 Q
Q 9.9.9 Q Q
Q 999.B.B.B Q
Q B.B.B.B.B.B Q
token = "Q9Q999Q9QQ99Q9Q9" Q
key = Q99QQ9Q999QQ9Q99 Q
sha Q999Q9QQ99Q9QQ99Q9Q9Q Q
Q 99Q 99Q Q
Q @ Q Q
Q @Q Q Q
Q [at] 99 Q
price 99.99 or 99,999.99 Q
Q 9-9-9 Q
999-9999 Q Q
isbn 999-9-999-99999-9 Q
Q (9999) Q Q
Q (999) Q Q
Q [99] Q (99) Q
99% of 999 Q
Q+9 Q
+9 Q Q
+99% Q
"""

_SLOT = re.compile(r"\{(\w+):([^}]*)\}")


def _filled(text: str, rng: random.Random) -> str:
    n = sum(c in "LN" for c in text)
    if n:
        body = [rng.randint(1, 9), *(rng.randrange(10) for _ in range(n - 1))]
        good = next(k for k in range(10) if luhn("".join(map(str, [*body[:-1], k]))))
        body[-1] = good if "L" in text else (good + rng.randint(1, 9)) % 10
        digits = iter(body)
        text = re.sub("[LN]", lambda m: str(next(digits)), text)
    text = re.sub("9", lambda m: str(rng.randrange(10)), text)
    text = re.sub("B", lambda m: str(rng.randrange(256)), text)
    return re.sub("Q", lambda m: "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 6))), text)


def labelled_rows(repeats: int = 6, seed: int = 7) -> tuple[list[list[str]], list[list[str]]]:
    """Words and labels of the table's rows, each filled in `repeats` times."""
    rng = random.Random(seed)
    words, gold = [], []
    for line in TABLE.splitlines() * repeats:
        text, spans = "", []
        for k, part in enumerate(_SLOT.split(line)):
            if k % 3 == 1:
                kind = part
                continue
            start = len(text)
            text += _filled(part, rng)
            if k % 3 == 2:
                spans.append((kind, start, len(text)))
        found = [(m.group(), m.start(), m.end()) for m in _WORD.finditer(text)]
        labels, last = [], None
        for _, start, end in found:
            span = next((s for s in spans if s[1] < end and start < s[2]), None)
            labels.append("O" if not span else ("I-" if span is last else "B-") + span[0])
            last = span
        words.append([w for w, _, _ in found])
        gold.append(labels)
    return words, gold


@lru_cache(maxsize=1)
def trained() -> ChainCRF:
    words, gold = labelled_rows()
    labels = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
    return ChainCRF(labels).fit([features(w) for w in words], gold)


# --- whole texts


def sequences(text: str) -> list[list[tuple[str, int, int]]]:
    """The words, with their places, around each signal of a text; nearby ones run together."""
    out: list[list[tuple[str, int, int]]] = []
    windows: list[list[int]] = []
    for m in _SIGNAL.finditer(text):
        start, end = m.start(), min(len(text), m.end() + AROUND)
        if windows and start - AROUND <= windows[-1][1]:
            windows[-1][1] = end
        else:
            windows.append([max(0, start - AROUND), end])
    for start, end in windows:
        words = [(m.group(), m.start(), m.end()) for m in _WORD.finditer(text, start, end)]
        # a word that the window cuts is left out, unless it is all there is
        if start and len(words) > 1 and words[0][1] == start and not text[start - 1].isspace():
            words = words[1:]
        out += [words[i : i + MAX_WORDS] for i in range(0, len(words), MAX_WORDS)]
    return out


def _labelled(words: list[tuple[str, int, int]], labels: list[str]) -> list[Span]:
    """Spans of a sequence, without marks at their ends."""
    out: list[list] = []
    for (_, start, end), label in zip(words, labels):
        kind = label[2:]
        if label[0] == "I" and out and out[-1][0] == kind and out[-1][3]:
            out[-1][2] = end
        elif label != "O":
            out.append([kind, start, end, True])
        elif out:
            out[-1][3] = False
    return [(k, a, b) for k, a, b, _ in out]


def _trimmed(text: str, span: Span) -> Span | None:
    kind, start, end = span
    while start < end and not (text[start].isalnum() or text[start] in "+("):
        start += 1
    while end > start and not text[end - 1].isalnum():
        end -= 1
    digits = sum(c in "0123456789" for c in text[start:end])
    if kind == "phone" and not 7 <= digits <= 15 or kind == "card" and not card_valid(text[start:end]):
        return None
    if kind == "ip" and _IP.fullmatch(text, start, end) and not ip_valid(text[start:end]):
        return None
    return (kind, start, end) if start < end else None


def all_spans(texts: list[str], model: ChainCRF | None = None) -> list[tuple[list[Span], list[Span]]]:
    """For each text its base spans, and those with what the field adds; in order."""
    model = model or trained()
    base = [base_spans(t) for t in texts]
    found = [(k, words) for k, t in enumerate(texts) for words in sequences(t)]
    added: dict[int, list[Span]] = {}
    found.sort(key=lambda x: len(x[1]))
    for at in range(0, len(found), 512):
        part = found[at : at + 512]
        for (k, words), labels in zip(part, model.decode([features([w for w, _, _ in x]) for _, x in part])):
            for span in _labelled(words, labels):
                span = _trimmed(texts[k], span)
                if span and not any(a < span[2] and span[1] < b for _, a, b in base[k]):
                    added.setdefault(k, []).append(span)
    return [(b, in_order([*b, *added.get(k, [])])) for k, b in enumerate(base)]


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def masked(text: str, spans: list[Span]) -> str:
    """text with the kind, in brackets and capitals, for each span; spans that overlap become one."""
    out, last = [], 0
    for kind, start, end in spans:
        if start >= last:
            out += [text[last:start], f"[{kind.upper()}]"]
        last = max(last, end)
    return "".join([*out, text[last:]])


def _found(model: ChainCRF):
    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = all_spans(texts, model)
            counts = [[sum(s[0] == k for s in base) for base, _ in rows] for k in KINDS]
            digest = [hashlib.sha256(written(base).encode()).hexdigest() for base, _ in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array(c, pa.int64()) for c in counts),
                    pa.array(digest, pa.string()),
                    pa.array([written(s) for _, s in rows], pa.string()),
                ],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    return run


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of docs.

    The counts and the digest are of the base spans; spans has all of them, as kind:start:end in code
    points. Null and empty texts have none. Repeated rows give repeated results.
    """
    return narrow(docs, "doc_id", "text").mapInArrow(
        _found(trained()),
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string",
    )


def mask_texts(docs: DataFrame) -> DataFrame:
    """docs with every span of its texts replaced by its kind; n_chars, where there is one, follows.

    Null texts stay null; columns other than text pass as they are.
    """
    bounded_batches(docs.sparkSession)
    model, place = trained(), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = batch.column(place).to_pylist()
            spans = all_spans([t or "" for t in texts], model)
            new = [t if t is None else masked(t, s) for t, (_, s) in zip(texts, spans)]
            columns = list(batch.columns)
            columns[place] = pa.array(new, columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
