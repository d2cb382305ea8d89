"""The inverted index and its rank; the literal ranks are those of text search in PostgreSQL."""

import pytest

from docquarry.operators import fulltext

TEXTS = [
    (1, "alpha beta", None), (2, "beta alpha", "alpha"), (3, "alpha x beta", ""), (4, "Alpha", None), (5, "alpha gamma alpha", "Title"),
    (6, None, None), (7, "", "beta"), (8, "álpha, BETA!", None), (9, "alpha " + "x " * 200 + "beta", None),
]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = spark.createDataFrame(TEXTS, "id long, body string, title string")
    found = fulltext.postings(rows, "id", {"D": "body", "A": "title"})
    return fulltext.write_index(found, str(tmp_path_factory.mktemp("index") / "t"), "id", 3)


def ranks(index, query):
    return {r.id: r["rank"] for r in fulltext.rank(index, "id", query).collect()}


def test_match(index):
    assert {r.id for r in fulltext.match(index, "id", "Alpha BETA").collect()} == {1, 2, 3, 8, 9}
    assert {r.id for r in fulltext.match(index, "id", "beta").collect()} == {1, 2, 3, 7, 8, 9}
    assert fulltext.match(index, "id", "alpha nothing").count() == 0
    assert fulltext.match(index, "id", " ,. ").count() == 0


def test_rank_of_one_word(index):
    got = ranks(index, "alpha")
    # fixed values: one place, two places
    assert got[1] == pytest.approx(0.0607927, abs=1e-6)
    assert got[5] == pytest.approx(0.0759909, abs=1e-6)
    assert got[2] == pytest.approx((1.0 + 0.1 + 0.25 - 0.25) / 1.64493406685, abs=1e-6)  # the title's weight counts most
    assert ranks(index, "title")[5] == pytest.approx(0.607927, abs=1e-6)


def test_rank_of_several_words(index):
    got = ranks(index, "alpha beta")
    # fixed values: neighbours, one word between
    assert got[1] == got[8] == pytest.approx(0.0991032, abs=1e-6)
    assert got[3] == pytest.approx(0.0985009, abs=1e-6)
    assert 0 <= got[9] < 1e-9  # out of reach
    assert got[2] > got[1]
    assert set(got) == {1, 2, 3, 8, 9}


def test_a_query_reads_its_lexemes_only(index):
    plan = fulltext.match(index, "id", "alpha beta")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(lexeme, [alpha,beta])]" in plan


def test_postings_are_made_inside_rows(spark):
    """No aggregate works on a row for each word; repeated ids are one document, and places behind the last one count once."""
    rows = [(1, "b a b"), (1, "a c"), (2, " ".join(["x"] * 300 + ["y"] * 16200)), (3, None), (4, "")]
    found = fulltext.postings(spark.createDataFrame(rows, "id int, t string"), "id", {"D": "t"})
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate") and "collect_set" not in plan
    got = {(r.id, r.lexeme): (r.positions, set(r.labels)) for r in found.collect()}
    assert got == {
        (1, "a"): ([1, 2], {"D"}), (1, "b"): ([1, 3], {"D"}), (1, "c"): ([2], {"D"}),
        (2, "x"): (list(range(1, 256)), {"D"}), (2, "y"): (list(range(301, 556)), {"D"}),
    }
