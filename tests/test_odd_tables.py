"""Queries against their SQL on tables unlike the given ones."""

import duckdb
from compare import same

from docquarry.plans import catalogue


def check(spark, folder, name, **tables):
    """The query and its SQL agree on tables that are given by SQL."""
    con = duckdb.connect()
    for table, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    same(catalogue.queries()[name](spark, str(folder)), con.sql(catalogue.oracle_sql()[name]))
    return con


def test_route_limits_of_events_close_together(spark, tmp_path):
    """Events of one client stand less than 3600 microseconds apart, in another order than their ids."""
    check(
        spark, tmp_path, "route_limits",
        events="""SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_microseconds(i * 7919 % 2003 * 10 + i // 300 * 86400000000) AS ts, CAST(i % 3 AS BIGINT) AS user_id,
        ['click', 'view', 'error', 'purchase', 'other'][1 + i % 5] AS event_type, 1.0::DOUBLE AS value, '{}' AS props FROM range(2000) t(i)""",
    )


def test_page_strings_of_cut_references(spark, tmp_path):
    check(
        spark, tmp_path, "page_strings",
        pages="""SELECT i AS page_id, ['<p>a &amp</p><b>&am</b>', '<p>a &amp; &lt &copy; &copy &#39; &#39 &</p>', '<p>x&ampy; z &amp;lt;</p>', '<p>&&amp;&</p>'][i] AS html FROM range(1, 5) t(i)""",
    )


def test_compliance_looks_at_all_requirements(spark, tmp_path):
    """More than twenty requirements in the first five communities."""
    con = check(
        spark, tmp_path, "compliance",
        part="SELECT i AS p_partkey, 'T' || i % 9 AS p_type, CAST(i % 50 AS INTEGER) AS p_size, CAST(i % 97 AS DOUBLE) AS p_retailprice FROM range(1, 2000) t(i)",
    )
    assert con.sql(f"SELECT count(*) FROM ({catalogue.oracle_sql()['compliance']})").fetchall() == [(45,)]


def test_resolution_stages_fold_equal_names(spark, tmp_path):
    """Many parts of few names; each stage's pairs, and merges, are those of its SQL."""
    part = """SELECT i AS p_partkey, ['red hammer', 'red hammer big', 'blue small bolt', 'blue bolt'][1 + i // 4 % 4] AS p_name, ['ECONOMY', 'SMALL', 'LARGE'][1 + i % 3] AS p_type,
    CAST(i * 7 % 4 + 5 * (i % 2) AS INTEGER) AS p_size, 'Brand#' || i % 5 AS p_brand FROM range(1, 900) t(i)"""
    for name in ("letter_stage", "word_stage", "substring_stage", "substring_merges"):
        (tmp_path / name).mkdir()
        check(spark, tmp_path / name, name, part=part)


def test_pairs_of_equal_names_are_made_once(spark, monkeypatch):
    """The grams of two names that many rows have meet as two rows."""
    from docquarry.operators import resolution

    seen = []

    def counted(rows, *rest):
        seen.append(rows.count())
        return resolution_pairs(rows, *rest)

    resolution_pairs = resolution.gram_pairs
    monkeypatch.setattr(resolution, "gram_pairs", counted)
    rows = spark.range(500).selectExpr("id entity_id", "if(id % 2 = 0, 'red hammer', 'red hammers') name", "'K' kind", "'d' document_id")
    found = resolution.letter_candidates(rows, over=0.5, most=5).collect()
    assert seen == [2]
    assert [(r.id1, r.id2, r.similarity) for r in found] == [(0, 2 * k, 1.0) for k in range(1, 6)]
