"""Chat formatting, the filter audit and cross-tokenizer alignment against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from compare import same
from fixtures import texts
from pyspark.sql import functions as F

from docquarry.llm import align, audit, chat, queries

SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()
CONVERSATIONS = "conv_id long, turn long, role string, text string"
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]"]


def _conversations(spark, sf_dir):
    odd = [
        (1, 0, "system", "be brief"), *[(1, t, ("user", "assistant")[t % 2 == 0], f"turn {t} " * (t % 9)) for t in range(1, 700)],
        (2, 0, "assistant", "x" * 9000), (2, 1, "user", None), (2, None, "user", "before all"), (2, 1, "user", None),
        (3, 0, "user", r"<s> <\s> </s>[INST] [\\/INST] [[INST] <<s>"), (3, 1, "assistant", r"[/INST]\ </s"), (3, 2, "assistant", ">s>"),
        (None, 5, None, "no key"), (None, 4, "assistant", "none"), (4, 0, "system", "y" * 20000), (4, 1, "user", "q"), (4, 2, "assistant", "a"),
        (5, 0, "system", ""), (5, 0, "system", ""), (5, 7, "tool</s>", "t"), (5, 1 << 40, "assistant", "late"),
    ]
    own = spark.createDataFrame(odd, CONVERSATIONS).selectExpr("if(conv_id is null, null, conv_id + 1000000) conv_id", "turn", "role", "text")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(own.columns).unionByName(own)
    return rows.withColumns({c: F.lit("clash") for c in ("block", "tokens", "at", "start", "piece", "ck", "held")})


def _turns(rows):
    found = defaultdict(list)
    for r in rows.select("conv_id", "turn", "role", "text").collect():
        found[r.conv_id].append((r.turn is not None, r.turn or 0, r.role or "", (r.text or "").encode()))
    return {k: [(role, text.decode()) for _, _, role, text in sorted(v)] for k, v in found.items()}


def test_chat_gives_back_what_went_in(spark, sf_dir):
    rows = _conversations(spark, sf_dir)
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(rows, 200, 60)).collect()}
    want = _turns(rows)
    assert set(got) == set(want)
    for key, turns in want.items():
        said = "".join(f"{role}\n{text}\n" for role, text in turns)
        loss = "".join(text for role, text in turns if role == "assistant")
        r = got[key]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), SHA(said), len(loss), SHA(loss))


def _plain_windows(turns, budget, history):
    """(at, turns, repeated) of one conversation, turn by turn."""
    size = [-(-len("<s>[INST][/INST]</s>" + _plain_escape(role) + _plain_escape(text)) // 4) for role, text in turns]
    system = size[0] if turns[0][0] == "system" else 0
    room = max(budget - history - system, 1)
    start, base, at = [sum(size[:i]) for i in range(len(size))], 0, []
    for i, n in enumerate(size):
        base = start[i] if n > history else base
        at.append(base + (start[i] - base) // room * room)
        base = start[i] + n if n > history else base
    out = []
    for w in sorted(set(at)):
        own = [i for i in range(len(size)) if at[i] == w]
        left, again = min(history, budget - system - sum(size[i] for i in own)), []
        for i in range(own[0] - 1, (0 if system else -1), -1):
            if start[own[0]] - start[i] > left:
                break
            again.insert(0, i)
        if system and own[0] > 0:
            again.insert(0, 0)
        out.append((w, [turns[i] for i in again + own], len(again), sum(size[i] for i in again + own)))
    return out


def _plain_escape(text):
    return re.sub(r"([<\[])(\\*/?(?:s>|INST\]))", r"\1\\\2", text)


@pytest.mark.parametrize(("budget", "history"), [(200, 60), (2048, 512), (50, 0)])
def test_chat_windows_hold_the_budget(spark, sf_dir, budget, history):
    rows = _conversations(spark, sf_dir)
    got = defaultdict(list)
    for r in chat.format_conversations(rows, budget, history).collect():
        got[r.conv_id].append(r)
    for key, turns in _turns(rows).items():
        have = sorted(got[key], key=lambda r: r.at)
        want = _plain_windows(turns, budget, history)
        assert [(r.at, r.repeated, r.tokens) for r in have] == [(w[0], w[2], w[3]) for w in want]
        system = turns[0][0] == "system"
        for r, (_, said, repeated, _) in zip(have, want):
            pieces = [f"<s>[INST]{_plain_escape(a)}[/INST]{_plain_escape(t)}</s>" for a, t in said]
            assert r.formatted == "".join(pieces)
            assert [r.formatted[s.start : s.end] for s in r.loss] == [_plain_escape(t) for a, t in said[repeated:] if a == "assistant"]
            body = re.sub("|".join(map(re.escape, CONTROL)), "", r.formatted)
            assert not any(c in _plain_escape(t) for _, t in said for c in CONTROL) and len(body) == len(r.formatted) - sum(len("<s>[INST][/INST]</s>") for _ in said)
            alone = len(said) - repeated == 1
            sized = -(-len(pieces[0]) // 4) if system else 0
            assert r.tokens <= budget or alone or sized > budget - history - 1


def test_chat_of_nothing(spark, sf_dir):
    assert chat.format_conversations(spark.createDataFrame([], CONVERSATIONS)).count() == 0
    made = queries.op11_chat(spark, sf_dir).where("conv_id = -1").first()
    assert (made.n_turns, made.loss_chars) == (2, len("</s>[INST] ok [/INST]"))


def test_audit_is_its_sql(spark, sf_dir, duck):
    same(queries.op12_audit(spark, sf_dir), duck.sql(queries.OP12_SQL))


def test_audit_of_odd_rows(spark, odd, labels):
    docs = odd.unionByName(
        spark.createDataFrame([(None, "same"), (7, "same"), (None, "same"), (9, "same"), (None, None)], "doc_id long, text string"), True
    ).withColumns({c: F.lit("clash") for c in ("words", "mask", "digest", "first", "part", "good", "f", "step", "found")})
    more = labels.unionByName(spark.createDataFrame([(900_001, 1, 1), (900_001, 0, 0), (None, 1, 1), (900_014, None, 1)], labels.schema))
    rows = [(r.doc_id, r.text or "", r.source or "") for r in docs.select("doc_id", "text", "source").collect()]
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t] = min(i, first.get(t, i))
    good, toxic = ({r.doc_id for r in more.collect() if r[c] == 1 and r.doc_id is not None} for c in ("quality", "toxic"))
    failed = []
    for i, t, part in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                 "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and t in first and i > first[t]}
        failed.append((part, {k for k, v in fails.items() if v}, i in good, i in toxic))
    got = audit.interaction_audit(docs, more).collect()
    assert len(got) == 600 * len({p for p, *_ in failed})
    shapley = Counter()
    for r in got:
        shapley[r.part, r.filter_order[r.step - 1]] += r.removed
    for r in got:
        f, before = r.filter_order[r.step - 1], set(r.filter_order[: r.step - 1])
        own = [x for x in failed if x[0] == r.part]
        gone = [x for x in own if f in x[1] and not x[1] & before]
        want = (sum(not x[1] & (before | {f}) for x in own), len(gone), sum(f in x[1] and bool(x[1] & before) for x in own),
                sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone), shapley[r.part, f])
        assert tuple(r)[3:] == want


def test_audit_of_nothing_and_of_other_filters(spark, odd, labels):
    assert audit.interaction_audit(odd.limit(0), labels).count() == 0
    two = audit.interaction_audit(odd, labels, {"S": "length(text) < 10", "L": "length(text) > 1000"}).collect()
    assert {(r.filter_order, r.step) for r in two} == {("SL", 1), ("SL", 2), ("LS", 1), ("LS", 2)}


def _plain_tokens(text):
    """Ids and bytes of both kinds by the two libraries themselves."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = align.default_vocabularies()
    if not hasattr(_plain_tokens, "own"):
        tok = Tokenizer.from_file(a_path)
        tok.encode_special_tokens = True
        _plain_tokens.own = tok, sentencepiece.SentencePieceProcessor(model_file=b_path)
    tok, sp = _plain_tokens.own
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in shown)}
    a = tok.encode(" " + text, add_special_tokens=False).ids
    b = sp.encode(text)
    of_a = [bytes(letters[c] for c in tok.id_to_token(i)) for i in a]
    of_b = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, map(sp.id_to_piece, b))]
    return list(zip(a, of_a)), list(zip(b, of_b))


def _plain_alignment(rows):
    found, counts = [], Counter()
    for i, text in rows:
        a, b = _plain_tokens(text) if text else ([], [])
        whole = b" " + text.encode()
        if not text or b"".join(t for _, t in a) != whole or b"".join(t for _, t in b) != whole:
            a, b = [], []
        ends = [{}, {}]
        for side, tokens in enumerate((a, b)):
            at = 0
            for k, (_, t) in enumerate(tokens):
                at += len(t)
                ends[side][at] = k
        groups, last, links = [], (0, 0), []
        for end in sorted(set(ends[0]) & set(ends[1])):
            x, y = ends[0][end], ends[1][end]
            groups.append(([t for t, _ in a[last[0] : x + 1]], [t for t, _ in b[last[1] : y + 1]]))
            links.append((a[x][0], b[y][0]))
            last = x + 1, y + 1
        counts.update(links)
        found.append((i, len(a), len(b), groups, links))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    for i, n_a, n_b, groups, links in found:
        shown = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        yield (
            i, n_a, n_b, len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links),
            SHA(shown) if groups else "", sum(len(x) * len(y) for x, y in groups),
        )


def test_alignment_is_that_of_the_libraries(spark, odd):
    more = [
        (910_001, "▁ a"), (910_002, "<s>[INST] <unk> <|endoftext|> <0x0A>"), (910_003, " \n\n  \t lead and end  "), (910_004, "日本語　とใช้ไทย"),
        (910_005, "é ﬁ ½ ﻿  "), (None, "no id"), (910_006, "\x00\x01\r\n"), (910_007, "'s 's'll 12345 don't" * 5), (910_008, " " * 5000),
    ]
    docs = odd.unionByName(spark.createDataFrame(more, "doc_id long, text string"), True)
    docs = docs.withColumns({c: F.lit("clash") for c in ("codes", "times", "n_a", "n", "groups_sha256")})
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    got = align.alignments(docs).drop("n_overlaps")
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(_plain_alignment(rows), key=key)


def test_alignment_of_nothing_and_its_bound(spark, documents):
    assert align.alignments(documents.limit(0)).count() == 0
    none = align.alignments(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()
    assert sorted(tuple(r)[:8] for r in none) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
    own = align.Aligner(*align.default_vocabularies())
    met = align.pair_counts(align.linked(documents)).collect()
    size = len(own.b.bytes)
    for r in met:
        x, y = sorted((own.a.bytes[r.code // size], own.b.bytes[r.code % size]), key=len)
        assert y.endswith(x)
    assert len(met) <= align.most_pairs(own.a.bytes, own.b.bytes) < 1_000_000
    assert len(texts(documents)) == align.linked(documents).count()
