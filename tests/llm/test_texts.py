"""Tokens, packing, personal data, languages, quality and vectors."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import same
from fixtures import ODD, texts
from pyspark.sql import functions as F

from docquarry.llm import bpe, langid, packing, pii, quality, queries, topk


@pytest.fixture(scope="module")
def tokenizer():
    return bpe.load_tokenizer(bpe.default_vocabulary())


def ids_of(tokenizer, docs):
    return [(i, tokenizer.encode(t, add_special_tokens=False).ids) for i, t in texts(docs)]


def test_bpe_is_the_librarys(odd, tokenizer):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(i, len(x), sha(" ".join(map(str, x))), sha(tokenizer.decode(x, skip_special_tokens=False))) for i, x in ids_of(tokenizer, odd)]
    assert sorted(map(tuple, bpe.digests(odd).collect())) == sorted(want)
    few = odd.where("doc_id between 900001 and 900011")
    got = sorted((r.doc_id, r.ids, r.decoded) for r in bpe.encode(few).collect())
    assert got == sorted((i, x, tokenizer.decode(x, skip_special_tokens=False)) for i, x in ids_of(tokenizer, few))


def test_packing(odd, tokenizer):
    want = []
    for i, x in ids_of(tokenizer, odd):
        x = [*x, 0]
        for p, a in enumerate(range(0, len(x), 2048)):
            part = x[a : a + 2048]
            want.append((i, p, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    got = packing.pack(odd).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    sizes = Counter(w[3] for w in want)
    assert len(bins) <= sum(n for _, n in packing.best_fit(dict(sizes), 2048))
    assert len(bins) >= -(-sum(w[3] for w in want) // 2048)


def test_bin_completion_beats_best_fit():
    counts = {6: 2, 5: 2, 4: 2, 3: 2, 2: 2}  # two bins of 20 each hold all
    assert sum(n for _, n in packing.bin_completion(counts, 20)) == 2
    packed = Counter()
    for pattern, n in packing.bin_completion({7: 3, 5: 4, 3: 5, 2: 1}, 12):
        assert sum(k * m for k, m in pattern) <= 12
        for k, m in pattern:
            packed[k] += m * n
    assert packed == {7: 3, 5: 4, 3: 5, 2: 1}


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            double = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 14 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in double) % 10 == 0,
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), k, kind, m.end()))
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out)]


def test_personal_data_base_spans(odd):
    got = {r.doc_id: r for r in pii.personal_data(odd).collect()}
    for i, t in texts(odd):
        want, row = plain_spans(t), got[i]
        assert row.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [row[f"n_{k}"] for k in PATTERNS] == [sum(w.startswith(k) for w in want) for k in PATTERNS]
        assert set(want) <= set(row.spans.split(","))


@pytest.mark.parametrize("text", [
    "a@b@c.d e.f@g.h.i @x.y a@b", "1.2.3.4.5.6.7.8 300.1.2.3 1.2.3.4", "4111-1111-1111-1111 4111 1111 1111 1112",
    "+1 (2) 3-4.5678901 +12 +1234567890123456 ++1 2345678901", "x" * 3000 + "@", "1." * 3000, "9 " * 3000, "٣+1 ٣",
])
def test_base_patterns_are_the_plain_ones(text):
    assert pii.written(pii.base_spans(text)) == ",".join(plain_spans(text))


def test_random_field_on_unseen_rows():
    words, gold = pii.labelled_rows(repeats=2, seed=991)
    found = pii.trained().decode([pii.features(w) for w in words])
    right = sum(a == b for x, y in zip(found, gold) for a, b in zip(x, y))
    assert right >= 0.97 * sum(map(len, gold))


def test_masking_keeps_the_rest(odd):
    got = {r.doc_id: r for r in pii.mask_texts(odd).collect()}
    assert got[900_015].text == "mail [EMAIL] or [IP], card [CARD], call [PHONE] now"
    assert got[900_001].text is None and got[900_004].text == "one" and got[900_004].h == "clash"


def test_languages_held_out(documents, odd):
    got = {r.doc_id: r for r in langid.held_out_languages(odd).collect()}
    assert len(got) == len({i for i, _ in texts(odd)})
    lang = {r.doc_id: r.lang for r in documents.collect() if r.text and r.lang and langid.has_letter(r.text)}
    held = [i for i in lang if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    assert sum(got[i].lang_pred == lang[i] for i in held) >= 0.95 * len(held)
    assert {got[i].lang_pred for i in (900_001, 900_002, 900_003, 900_011)} == {"und"}
    assert all(0 <= r.score <= 1 for r in got.values())


def _kneser_ney(counts):
    """A function from an n-gram to the probability of its last symbol, straight from the definition."""
    orders = [counts]
    while len(next(iter(orders[0]))) > 1:
        lower = {}
        for gram in orders[0]:
            lower[gram[1:]] = lower.get(gram[1:], 0) + 1
        orders.insert(0, lower)
    base = 1 / (len(orders[0]) + 1)

    def p(gram):
        if not gram:
            return base
        own = orders[len(gram) - 1]
        n1, n2, n3, n4 = (sum(n == k for n in own.values()) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
        ratio = [(n2, n1), (n3, n2), (n4, n3)]
        raw = [k - (k + 1) * y * m / n if n else min(k, 2) * 0.5 for k, (m, n) in enumerate(ratio, 1)]
        d = [min(max(x, 0.05), k - 0.05) for k, x in enumerate(raw, 1)]
        same = [n for g, n in own.items() if g[:-1] == gram[:-1]]
        if not same:
            return p(gram[1:])
        n = own.get(gram, 0)
        kept = n - d[min(n, 3) - 1] if n else 0
        return (kept + sum(d[min(m, 3) - 1] for m in same) * p(gram[1:])) / sum(same)

    return p


def test_perplexity_against_brute_force(spark):
    data = [(i, "en", f"the cat {w} on the mat. the {w} ate the hat") for i, w in enumerate("sat lay ran sang slept".split())]
    data += [(10, "zh", "\u6211\u7231\u5317\u4eac\u5929\u5b89\u95e8 \u6211\u7231\u4f60"), (11, "zh", "\U0001f600\U0001f600 \u95e8"), (12, None, None)]
    data += [(13, "en", ""), (None, "en", "zzz qqq"), (0, "en", data[0][2]), (14, "fr", "the mat. " * 300)]
    docs = spark.createDataFrame(data, "doc_id long, lang string, text string").repartition(3, "text")
    trusted = spark.createDataFrame([(i,) for i in (0, 1, 2, 3, 4, 10)], "doc_id long")
    fold = {r.text: r.fold for r in docs.selectExpr("text", f"pmod(xxhash64(text), {quality.HELD}) fold").collect()}
    counts = {}
    behind = lambda t: ["\n\n\n\n"[i:] + t[: i + 1] if i < 4 else t[i - 4 : i + 1] for i in range(len(t))]
    for i, _, text in data:
        if i in (0, 1, 2, 3, 4, 10) and fold[text]:
            for gram in behind(text):
                counts[gram] = counts.get(gram, 0) + 1
    p = _kneser_ney(counts)
    assert abs(sum(p("e ca" + c) for c in {g[-1] for g in counts} | {"\uffff"}) - 1) < 1e-9
    got = sorted((r.doc_id or -1, r.symbols, r.bits) for r in quality.perplexities(docs, trusted).collect())
    want = sorted(
        (i or -1, len(t or "") if t is not None else 0, -sum(np.log2(p(g)) for g in behind(t)) / len(t) if t else None)
        for i, _, t in data
    )
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all((a[2] is None) == (b[2] is None) and (a[2] is None or abs(a[2] - b[2]) < 1e-6) for a, b in zip(got, want))


def test_windows_of_long_texts(monkeypatch):
    monkeypatch.setattr(quality, "PART", 7)
    texts = ["abcdefghijklmnopqrstuvwxyz", None, "", "\u95e8\U0001f600", "xyz" * 9]
    got = [[] for _ in texts]
    for joined, rows, codes, starts in quality.windows(texts):
        assert len(rows) == len(codes) == len(starts)
        for row, code, start in zip(rows, codes, starts):
            gram = joined[start : start + quality.ORDER]
            assert code == quality.hashed(gram)[0]
            got[row].append(gram)
    assert got == [[("\n" * 4 + (t or ""))[i : i + 5] for i in range(len(t or ""))] for t in texts]


def test_quality_rejects_the_bad(documents, labels, odd):
    got = {r.doc_id: r for r in quality.judge(odd, labels).collect()}
    marks = [r for r in labels.collect() if r.doc_id in got]
    good = [got[r.doc_id].kept for r in marks if r.quality == 1 and not r.toxic]
    assert sum(good) >= 0.97 * len(good)
    bad = [got[r.doc_id].kept for r in marks if r.quality == 0]
    assert bad and sum(bad) <= 0.1 * len(bad)
    assert got[900_001].kept and got[900_002].kept and got[900_001].perplexity is None
    assert not got[900_014].kept  # one letter, over and over
    kept = quality.keep_good(odd, labels)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in texts(odd) if got[i].kept)
    assert quality.judge(documents.where("false"), labels).count() == 0
    assert quality.judge(documents, labels.where("false")).where("kept").count() == documents.count()


def test_quality_judges_any_frame_by_row(spark, documents, labels):
    good = documents.join(labels.where("quality = 1 and toxic = 0"), "doc_id", "left_semi").orderBy("doc_id").first()
    bad = "q" * 400
    more = [(900_101, good.text, good.lang), (900_101, bad, good.lang), (None, bad, good.lang), (None, good.text, good.lang), (None, good.text, good.lang), (None, None, None)]
    docs = documents.unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string"), True)
    plain = {(r.doc_id, r.text_hash, r.lang): r.kept for r in quality.judge(docs, labels).collect()}
    # rows that a shuffle deals anew, and rows of a join
    other = docs.repartition(7).join(docs.select("lang").distinct(), "lang", "left")
    assert {(r.doc_id, r.text_hash, r.lang): r.kept for r in quality.judge(other, labels).collect()} == plain
    kept = quality.keep_good(docs.repartition(5), labels)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert (900_101, good.text) in got and (900_101, bad) not in got
    assert sorted(t or "" for i, t in got if i is None) == sorted(["", good.text, good.text])
    hashes = docs.select("doc_id", "text", "lang", F.xxhash64("text").alias("h")).collect()
    assert sorted(map(str, got)) == sorted(str((r.doc_id, r.text)) for r in hashes if plain[r.doc_id, r.h, r.lang])


def test_top_k(spark, sf_dir, duck):
    same(queries.op2_topk(spark, sf_dir), duck.sql(queries.OP2_SQL))


def test_top_k_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 2.0]), (50, [1.0, 2.0]), (51, [1.0, 2.0]), (51, [1.0, 2.0]), (52, [-1.0, 0.0]), (53, None),
            (54, [nan, 1.0]), (55, [inf, 1.0]), (56, [None, 1.0]), (100, [0.0, 0.0]), (None, [1.0, 1.0])]
    rows = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    v = topk.whole_vectors(rows)
    got = sorted(map(tuple, topk.top_k(v.where("vec_id % 50 = 0"), v, 2).collect()))
    one = 256 * 256 * 5
    assert got == [(0, 1, 50, one), (0, 2, 51, one), (50, 1, 0, one), (50, 2, 51, one), (100, 1, 0, 0), (100, 2, 50, 0)]
    assert topk.top_k(v.where("false"), v).count() == 0
    assert topk.top_k(v.where("vec_id = 0"), v.where("vec_id = 0")).count() == 0


def test_top_k_against_numpy(spark):
    rng = np.random.default_rng(11)
    x = rng.integers(-40, 40, (900, 24)) * rng.integers(1, 9, (900, 1))
    v = spark.createDataFrame([(i, [int(c) for c in r]) for i, r in enumerate(x)], "vec_id long, v array<long>")
    score = x @ x.T
    want = []
    for q in range(0, 900, 50):
        order = sorted((c for c in range(900) if c != q), key=lambda c: (-score[q, c], c))[:5]
        want += [(q, k, c, int(score[q, c])) for k, c in enumerate(order, 1)]
    assert sorted(map(tuple, topk.top_k(v.where("vec_id % 50 = 0"), v).collect())) == want


def test_empty_tables(documents):
    none = documents.where("false")
    for found in (bpe.digests(none), packing.pack(none), pii.personal_data(none), langid.held_out_languages(none)):
        assert found.collect() == []
    assert len(ODD) > 10
