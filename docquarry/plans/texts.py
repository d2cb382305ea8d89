"""Full-text search, text functions and entity resolution on names and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.functions.markup import page_text
from docquarry.operators import fulltext
from docquarry.operators.entities import contained_pairs, duplicate_groups, gram_pairs
from docquarry.operators.find import found_on_pages
from docquarry.plans.registry import query
from docquarry.plans.shared import document_index
from docquarry.session import ship_package
from docquarry.sources import load

_FOLD = f"lower(translate(text, '{T.ACCENTED}', '{T.PLAIN}'))"
_LEX = f"list_distinct(list_filter(string_split_regex({_FOLD}, '[^a-z0-9]+'), lambda w: w <> ''))"
_NORM = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[–—]', '-', 'g'), '[\"''„“”]', '', 'g'), '[()]', '', 'g'), '\\s*[-/]\\s*', '-', 'g'), ',\\s*', ' ', 'g'), '\\s+', ' ', 'g'))"


def _names(spark, sf_dir):
    """Different part names with their smallest key."""
    return load(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))


@query(f"SELECT doc_id FROM (SELECT doc_id, {_LEX} AS lex FROM documents) WHERE list_has_all(lex, ['the', 'and', 'tion'])")
def fts_match(spark, sf_dir):
    return fulltext.match(document_index(spark, sf_dir), "doc_id", "The and TION")


_PLACES = f"""places AS (SELECT doc_id, w, least(spot, 16383) AS spot FROM (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS spot
FROM (SELECT doc_id, list_filter(string_split_regex({_FOLD}, '[^a-z0-9]+'), lambda w: w <> '') AS words FROM documents)) WHERE w IN ('the', 'and', 'tion')),
kept AS (SELECT DISTINCT doc_id, w, spot FROM places QUALIFY dense_rank() OVER (PARTITION BY doc_id, w ORDER BY spot) <= 255)"""


@query(f"""WITH {_PLACES}, whole AS (SELECT doc_id FROM kept WHERE w IN ('the', 'and') GROUP BY doc_id HAVING count(DISTINCT w) = 2),
near AS (SELECT a.doc_id, sum(CASE WHEN abs(a.spot - b.spot) BETWEEN 1 AND 100 THEN ln(1 - sqrt(0.1 * 0.1 / (1.005 + 0.05 * exp(abs(a.spot - b.spot) / 1.5 - 2)))) ELSE 0 END) AS l
FROM kept a JOIN kept b ON a.doc_id = b.doc_id AND a.w = 'the' AND b.w = 'and' GROUP BY 1)
SELECT doc_id, round(CASE WHEN exp(l) < 1 THEN 1 - exp(l) ELSE 1e-20 END, 6) AS rank FROM near JOIN whole USING (doc_id) ORDER BY rank DESC, doc_id LIMIT 20""")
def fts_rank(spark, sf_dir):
    """Documents with both words of a query by how close these stand."""
    found = fulltext.rank(document_index(spark, sf_dir), "doc_id", "the AND")
    return found.orderBy(F.desc("rank"), "doc_id").limit(20)


@query(f"""WITH {_PLACES}, n AS (SELECT doc_id, least(count(*), 255) AS n FROM kept WHERE w = 'tion' GROUP BY 1)
SELECT doc_id, round((SELECT sum(0.1 / (i * i)) FROM range(1, 256) t(i) WHERE i <= n.n) / 1.64493406685, 6) AS rank FROM n""")
def fts_rank_word(spark, sf_dir):
    """Documents by how often one word stands in them."""
    return fulltext.rank(document_index(spark, sf_dir), "doc_id", "Tion")


@query(f"SELECT doc_id, CAST((length(t) - length(replace(t, 'tion', ''))) / 4 AS INTEGER) AS n FROM (SELECT doc_id, {_FOLD} AS t FROM documents) WHERE contains(t, 'tion')")
def page_find(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select("doc_id", T.occurrences("text", "TIÓN").alias("n"))
    return rows.where("n > 0")


@query(f"""SELECT name_key, entity_type, CAST(min(entity_id) AS BIGINT) AS canonical_id, min_by(name, entity_id) AS canonical_name, CAST(count(*) AS BIGINT) AS n, CAST(sum(entity_id) AS BIGINT) AS id_sum
FROM (SELECT p_partkey AS entity_id, p_name AS name, lower(p_name) AS name_key, p_type AS entity_type FROM part) GROUP BY 1, 2 HAVING count(*) > 1""")
def exact_dedup_groups(spark, sf_dir):
    rows = load(spark, sf_dir, "part").selectExpr("p_partkey entity_id", "p_name name", "p_type entity_type")
    groups = duplicate_groups(rows, F.lower("name"), [-F.length("name")])
    return groups.selectExpr("name_key", "entity_type", "canonical_id", "canonical_name", "n", "aggregate(entity_ids, 0L, (a, x) -> a + x) id_sum")


_DASHED = "CASE WHEN p_partkey % 2 = 0 THEN replace(p_name, ' ', ' – ') ELSE upper(replace(p_name, ' ', '-')) END"


@query(f"""SELECT name_key, entity_type, CAST(count(*) AS BIGINT) AS n, CAST(min(entity_id) FILTER (WHERE long) AS BIGINT) AS canonical_id FROM (
SELECT *, length(name) = max(length(name)) OVER (PARTITION BY name_key, entity_type) AS long FROM (SELECT p_partkey AS entity_id, {_DASHED} AS name, {_NORM.format(x=_DASHED)} AS name_key, p_brand AS entity_type FROM part)) GROUP BY 1, 2 HAVING count(*) > 1""")
def normalized_dedup(spark, sf_dir):
    name = F.expr("if(p_partkey % 2 = 0, replace(p_name, ' ', ' – '), upper(replace(p_name, ' ', '-')))")
    rows = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), name.alias("name"), F.col("p_brand").alias("entity_type"))
    return duplicate_groups(rows, T.normalized_name("name"), [-F.length("name")]).select("name_key", "entity_type", "n", "canonical_id")


_N = "(SELECT p_name AS name, min(p_partkey) AS id FROM part GROUP BY p_name)"
_PY = "list_distinct(list_transform(range(1, length(name) + 2), lambda i: substr('  ' || lower(name) || ' ', i, 3)))"
_PG = "list_distinct(flatten(list_transform(list_filter(string_split_regex(lower(name), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def _gram_sql(grams: str, least: float) -> str:
    return f"""WITH n AS (SELECT id, name, {grams} AS g FROM {_N})
SELECT id1, id2, similarity FROM (SELECT a.id AS id1, b.id AS id2, round(len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))), 6) AS similarity,
len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))) AS s FROM n a JOIN n b ON a.id < b.id) WHERE s >= {least}"""


@query(_gram_sql(_PY, 0.5))
def trigram_pairs_whole(spark, sf_dir):
    return gram_pairs(_names(spark, sf_dir), T.trigrams("name"), 0.5)


@query(_gram_sql(_PG, 0.5))
def trigram_pairs_words(spark, sf_dir):
    return gram_pairs(_names(spark, sf_dir), T.word_trigrams("name"), 0.5)


@query(_gram_sql("list_distinct(list_filter(string_split(name, ' '), lambda w: w <> ''))", 0.3))
def word_overlap_pairs(spark, sf_dir):
    return gram_pairs(_names(spark, sf_dir), T.words("name"), 0.3)


@query(f"""SELECT a.id AS short_id, b.id AS long_id, a.name AS short, b.name AS long FROM {_N} a JOIN {_N} b ON contains(b.name, a.name) AND length(a.name) < length(b.name)
AND length(a.name) >= 0.4 * length(b.name) AND contains(a.name, ' ')""")
def substring_pairs(spark, sf_dir):
    return contained_pairs(_names(spark, sf_dir).withColumn("kind", F.lit("part"))).select("short_id", "long_id", "short", "long")


@query("""SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) || '/' || CAST(year(o_orderdate) AS VARCHAR) AS citation FROM orders""")
def citation_extract(spark, sf_dir):
    text = F.concat(F.lit("zákon č. "), F.col("o_orderkey"), F.lit("/"), F.year("o_orderdate"), F.lit(" Sb., § 3"))
    rows = load(spark, sf_dir, "orders")
    return rows.select("o_orderkey", T.citation_number(text).alias("citation"))


@query("""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'),
'&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) AS body FROM pages""")
def html_text(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", T.html_text("html").alias("body"))


@query(r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', '<x>', 'g'), '(?s)<!--.*?-->', '<x>', 'g') AS h FROM pages),
s AS (SELECT page_id, list_transform(string_split_regex(h, '<[^>]+>'), lambda x: regexp_replace(replace(replace(replace(replace(replace(replace(replace(x, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '^\s+|\s+$', '', 'g')) AS l FROM p)
SELECT page_id, array_to_string(list_filter(l, lambda x: x <> ''), chr(10)) AS body FROM s""")
def page_strings(spark, sf_dir):
    """The strings of pages, a line each, by a tokenising parser."""
    ship_package(spark)
    return load(spark, sf_dir, "pages").select("page_id", page_text("html").alias("body"))


@query("""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS page_number FROM documents),
n AS (SELECT doc_id, page_number, lower(strip_accents(t)) AS t FROM p), c AS (SELECT *, (length(t) - length(replace(t, 'tion', ''))) // 4 AS n FROM n)
SELECT doc_id, CAST(page_number AS INTEGER) AS page_number, CAST(unnest(range(0, n)) AS INTEGER) AS match_index FROM c WHERE n > 0""")
def page_find_places(spark, sf_dir):
    """Every place of a phrase by page, whatever the accents; lines stand for pages."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "text"))
    return found_on_pages(docs.selectExpr("doc_id", "at + 1 page_number", "text"), "TIÓN", ["doc_id", "page_number"])


@query("""SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) BETWEEN 40 AND 60""")
def json_props(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return rows.where("k between 40 and 60")


@query("""SELECT doc_id, CASE WHEN length(t) <= 50 THEN t WHEN length(w) < 25 THEN left(t, 47) || '...' ELSE w || '...' END AS title FROM (
SELECT doc_id, t, CASE WHEN contains(left(t, 50), ' ') THEN regexp_extract(left(t, 50), '(?s)^(.*) [^ ]*$', 1) ELSE left(t, 50) END AS w FROM (SELECT doc_id, trim(text) AS t FROM documents))""")
def fallback_titles(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", T.fallback_title("text").alias("title"))


@query("""SELECT doc_id, CASE WHEN length(text) > 300 THEN left(text, 150) || ' [...pruned...] ' || right(text, 100) ELSE text END AS pruned, CAST(greatest(1, ceil(length(text) / 4.0)) AS INTEGER) AS tokens FROM documents""")
def pruned_texts(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", T.pruned("text").alias("pruned"), T.estimated_tokens("text").alias("tokens"))


@query("""SELECT DISTINCT item_id, doc_id FROM benchmark JOIN documents ON contains(documents.text, benchmark.text)""")
def benchmark_containment(spark, sf_dir):
    """Benchmark passages that documents hold as they are. A passage and a text meet through the
    passage's rarest eight-word run; the rest is verified."""
    runs = F.expr("transform(sequence(0, greatest(size(w) - 8, 0)), i -> xxhash64(array_join(slice(w, i + 1, 8), ' ')))")
    words = F.split("text", " ")
    docs = load(spark, sf_dir, "documents")
    keyed = docs.select("doc_id", words.alias("w")).select("doc_id", F.explode(F.array_distinct(runs)).alias("key"))
    items = load(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"), words.alias("w"))
    # the first word may be glued to what stands before a passage and the last to what follows
    inner = F.expr("xxhash64(array_join(slice(w, 2, 8), ' ')) key")
    met = keyed.join(items.select("item_id", "passage", inner), "key").select("item_id", "passage", "doc_id").distinct()
    return met.join(docs.select("doc_id", "text"), "doc_id").where(F.contains("text", "passage")).select("item_id", "doc_id").distinct()


@query("""SELECT item_id, 'doc_' || CAST(item_id AS VARCHAR) || '_p' || lpad(CAST(item_id % 1000 AS VARCHAR), 3, '0') AS page_id, 'doc_' || CAST(item_id AS VARCHAR) AS document, CAST(item_id % 1000 AS INTEGER) AS page FROM benchmark""")
def page_id_codec(spark, sf_dir):
    rows = load(spark, sf_dir, "benchmark").select("item_id", T.page_id(F.concat(F.lit("doc_"), "item_id"), F.col("item_id") % 1000).alias("page_id"))
    document, page = T.page_parts("page_id")
    return rows.select("item_id", "page_id", document.alias("document"), page.alias("page"))
