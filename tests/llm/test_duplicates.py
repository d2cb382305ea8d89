"""Near and exact duplicates, line dedup and repeated bytes against brute force."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from fixtures import SHARED, groups_of, texts

from docquarry.llm import exact, lines, queries, simhash, suffix
from compare import rows, same

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text).encode()
    words = WORDS.findall(lower)
    if not words:
        return 0
    shingles = [words[i : i + 3] for i in range(len(words) - 2)] or [words]
    h = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("bucket", [simhash.MAX_BUCKET, 2])
def test_simhash_links_all_within_two_bits(odd, bucket):
    prints = [(i, plain_fingerprint(t)) for i, t in texts(odd)]
    least = {}
    for i, p in prints:
        least[p] = min(i, least.get(p, i))
    near = [(least[a], least[b]) for a in least for b in least if a < b and (a ^ b).bit_count() <= 2]
    top = groups_of(near, set(least.values()))
    want = sorted((i, f"{p:016x}", top[least[p]]) for i, p in prints)
    got = simhash.near_duplicates(odd, bucket)
    assert sorted(map(tuple, got.select("doc_id", "fingerprint", "component_id").collect())) == want


def test_simhash_finds_planted_bits(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 1 << 63, 40)]
    near = [x ^ (1 << int(a)) ^ (1 << int(b)) for x in base for a, b in rng.integers(0, 64, (6, 2))]
    all_of = sorted({(x ^ (1 << 63)) - (1 << 63) if x >> 63 else x for x in [*base, *near]})
    want = groups_of([(a, b) for a in all_of for b in all_of if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2], all_of)
    prints = spark.createDataFrame([(x,) for x in all_of], "fp long")
    for bucket in (simhash.MAX_BUCKET, 2):
        pairs = [(r.src, r.dst) for r in simhash.links(prints, bucket).collect()]
        assert groups_of(pairs, all_of) == want


def test_simhash_keeps_one_of_each_group(odd):
    kept = [r.doc_id for r in simhash.keep_representatives(odd).collect()]
    groups = {r.component_id for r in simhash.near_duplicates(odd).collect()}
    assert sorted(kept) == sorted(groups)
    assert simhash.keep_representatives(odd).columns == odd.columns


def test_simhash_keeps_columns_of_its_own_names(documents):
    docs = documents.selectExpr("*", "'a' _text_hash", "'b' _text_hash_", "1 fp", "2 first")
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns
    assert {(r["_text_hash"], r["_text_hash_"], r.fp, r["first"]) for r in kept.collect()} == {("a", "b", 1, 2)}


def test_simhash_keeps_one_of_each_group_whatever_the_ids(spark):
    one, two, three = ("the first text of its own", "another one with different words", "yet a third that nothing is like")
    rows = [(None, one), (None, two), (None, two), (7, three), (None, three), (8, one + " a"), (8, two + " and more of them")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(simhash.keep_representatives(docs).collect(), key=str)
    assert sorted(map(tuple, got), key=str) == sorted([(None, one), (None, two), (7, three), (8, one + " a"), (8, two + " and more of them")], key=str)


def test_exact_duplicates(spark, sf_dir, duck, odd):
    same(queries.op9_exact_dedup(spark, sf_dir), duck.sql(queries.OP9_SQL))
    of = defaultdict(list)
    for i, t in texts(odd):
        of[t].append(i)
    want = [(i, max(of[t]), len(of[t]), i == max(of[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts(odd)]
    got = exact.exact_duplicates(odd)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def line_links(found):
    """Links at the similarity among different long lines, by brute force over an inverted index."""
    sets = {x: {(x + " " * 5)[m.start() : m.start() + 6] for m in re.finditer(r"(?<!\S)(?=\S.{5})", x + " " * 5, re.S)} for x in found}
    index = defaultdict(list)
    for x, s in sets.items():
        for g in s:
            index[g].append(x)
    links = []
    for x, s in sets.items():
        shared = defaultdict(int)
        for g in s:
            for y in index[g]:
                if y > x:
                    shared[y] += 1
        links += [(x, y) for y, n in shared.items() if n >= 0.8 * (len(s) + len(sets[y]) - n)]
    return links


def test_line_dedup(odd):
    odd = odd.dropDuplicates(["doc_id"]).where("doc_id not in (900012, 900013)")
    split = [(i, k, x) for i, t in odd.select("doc_id", "text").collect() if t is not None for k, x in enumerate(t.split("\n"))]
    judged = [r for r in split if len(x := r[2].strip(" ")) - len(x.replace(" ", "")) >= 4]
    links = line_links({x for _, _, x in judged})
    top = groups_of(links, {x for _, _, x in judged})
    first = {}
    for i, k, x in judged:
        first[top[x]] = min((i, k), first.get(top[x], (i, k)))
    got = {(r.doc_id, r.line_no): r for r in lines.line_dedup(odd).collect()}
    assert sorted(got) == sorted((i, k) for i, k, _ in split)
    short = {(i, k) for i, k, _ in split} - {(i, k) for i, k, _ in judged}
    assert all(got[p].kept and got[p].n_lines == 1 for p in short)
    # banding may miss a link, never add one
    wrong = [p for i, k, x in judged if (p := (i, k)) and got[p].kept != (first[top[x]] == p)]
    assert len(wrong) <= 0.005 * len(judged)
    assert all(got[p].kept for p in wrong)
    for i, k, x in judged:
        assert top[x] == top[next(z for a, b, z in judged if (a, b) == (got[i, k].keep_doc_id, got[i, k].keep_line_no))]


def test_full_bucket_misses_no_link(spark, monkeypatch):
    rng = np.random.default_rng(11)
    texts = set()
    for _ in range(60):
        words = [f"w{x:05d}" for x in rng.integers(0, 1 << 16, rng.integers(9, 14))]
        texts |= {" ".join(words), " ".join([*words, "more"]), " ".join([*words[:4], "else", *words[4:]])}
    # one bucket for all lines, in blocks of a few
    monkeypatch.setattr(lines, "bands", lambda signed: signed.selectExpr("lid", "shingles", "0L key"))
    monkeypatch.setattr(lines, "BLOCK", 2, raising=False)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(sorted(texts))], "doc_id long, text string")
    of = {r.lid: r.line for r in lines.lines_of(docs).collect()}
    got = defaultdict(set)
    for r in lines.linked_lines(lines.lines_of(docs)).collect():
        got[r.component].add(of[r.lid])
    want = defaultdict(set)
    for x, top in groups_of(line_links(texts), texts).items():
        want[top].add(x)
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_no_pair_at_the_similarity_is_left_out(spark):
    rng = np.random.default_rng(17)
    pairs = []
    for n, gone in [(18, 2)] * 700 + [(9, 1)] * 100 + [(5, 1)] * 50:
        words = ["".join(w) for w in rng.choice(list("abcdefghijklmnopqrstuvwxyz"), (n + gone, 7))]
        # of so many words each line lacks its own, or one line lacks some that the other has
        pairs.append((" ".join(words[:n]), " ".join(words[gone:] if n > 5 else words[: n - gone] + words[:1])))
    texts = {x for pair in pairs for x in pair}
    assert sorted(line_links(texts)) == sorted(map(tuple, map(sorted, pairs)))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(sorted(texts))], "doc_id long, text string")
    of = {r.line: r.lid for r in lines.lines_of(docs).collect()}
    found = {r.lid: r.component for r in lines.linked_lines(lines.lines_of(docs)).collect()}
    assert [p for p in pairs if found.get(of[p[0]]) is None or found[of[p[0]]] != found.get(of[p[1]])] == []


def test_query_judges_every_line_that_is_not_blank(spark, tmp_path):
    tabs = "\t".join(f"word{i:02d}" for i in range(14))
    texts = ["All rights reserved.\n\n漢字だけの行です", "漢字だけの行です\nAll rights reserved.\n", tabs, tabs + "\televen", " \t\n \t"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    gone = {(r.doc_id, r.line_no) for r in queries.op10_line_dedup(spark, str(tmp_path)).where("not kept").collect()}
    assert gone == {(1, 0), (1, 1), (3, 0)}


def test_lines_of_words_with_common_heads_stay(spark):
    urls = [" ".join(f"https://example.org/{name}/{i}" for i in range(5)) for name in ("one", "two", "three")]
    ids = [" ".join(f"20260000{x * 7919 + i:06d}" for i in range(6)) for x in range(3)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(urls + ids)], "doc_id long, text string")
    assert all(r.kept and r.n_lines == 1 for r in lines.line_dedup(docs).collect())


def test_line_dedup_takes_lines_out(spark):
    line = "this line stands in two of the documents here"
    docs = spark.createDataFrame([(1, f"a\n{line}\nb", 1), (2, f"{line}.\nc", 1), (3, None, 1), (4, line, 1)], "doc_id long, text string, n_chars long")
    got = sorted(map(tuple, lines.remove_lines(docs).collect()))
    assert got == [(1, f"a\n{line}\nb", len(line) + 4), (2, "c", 1), (3, None, None), (4, "", 0)]


def test_suffix_arrays():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 4, 50, 400):
        for symbols in (1, 2, 5):
            text = rng.integers(0, symbols, n)
            want = sorted(range(n), key=lambda i: text[i:].tolist())
            assert suffix.suffix_array(text).tolist() == want


def brute_repeats(docs):
    first = {}
    for i, t in docs:
        data = t.encode()
        for a in range(len(data) - 49):
            s = data[a : a + 50]
            first[s] = min(i, first.get(s, i))
    out = []
    for i, t in docs:
        data = t.encode()
        gone = np.zeros(len(data) + 1, bool)
        for a in range(len(data) - 49):
            if first[data[a : a + 50]] < i:
                gone[a : a + 50] = True
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = int((gone[1:-1] > gone[:-2]).sum() + gone[:1].sum())
        out.append((i, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("frequent", [None, 2])
def test_repeated_bytes(odd, frequent, monkeypatch):
    if frequent:
        monkeypatch.setattr(suffix, "FREQUENT", frequent)
    docs = odd.where("doc_id < 120 or doc_id > 900000 and doc_id not in (900012, 900014)")
    assert sum(SHARED in t for _, t in texts(docs)) == 3
    assert sorted(map(tuple, suffix.digests(docs).collect())) == brute_repeats(texts(docs))


def test_repeated_rows_take_nothing_from_each_other(odd):
    got = suffix.digests(odd.where("doc_id = 900014")).collect()
    assert [(r.n_bytes, r.n_removed) for r in got] == [(70_000, 0)] * 2


def test_empty_tables(documents):
    none = documents.where("false")
    for found in (simhash.near_duplicates(none), exact.exact_duplicates(none), lines.line_dedup(none), suffix.digests(none)):
        assert rows(found.columns, found.collect()) == []


def test_long_lines_that_differ_are_no_candidates(spark):
    rng = np.random.default_rng(29)
    words = [["".join(w) for w in rng.choice(list("abcdefghijklmnopqrstuvwxyz"), (110, 7))] for _ in range(20)]
    # 110 words each, and of every other line a copy without some
    texts = [" ".join(x) for x in words] + [" ".join(x[n % 20 :]) for n, x in enumerate(words) if n % 2]
    of = lines.lines_of(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    signed = lines.signatures(of, lines.repeated(of)).select("lid", "shingles")
    met = signed.toDF("a", "s").crossJoin(signed.toDF("b", "t")).where(f"a < b and {lines._near(0.8)}").select("a", "b")
    lid = {r.line: r.lid for r in of.collect()}
    assert {tuple(r) for r in met.collect()} == {tuple(sorted((lid[x], lid[y]))) for x, y in line_links(set(texts))}
