"""Entity resolution on parts: their names, some lengthened, stand for entities of kinds and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.operators import resolution
from docquarry.plans.registry import query
from docquarry.plans.texts import _NORM, _PG, _PY
from docquarry.sources import load

_NAME = "CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' ' || lower(p_type) WHEN 2 THEN 'Old ' || p_name ELSE p_name || ' - no ' || p_size END"
_KIND = "CASE p_type WHEN 'ECONOMY' THEN 'SECTION' WHEN 'SMALL' THEN 'REQUIREMENT' ELSE p_type END"
_E = f"""e AS (SELECT p_partkey AS entity_id, {_NAME} AS name, {_KIND} AS kind, 'd' || p_size % 5 AS document_id, CASE WHEN p_partkey % 7 < 5 THEN p_brand END AS description FROM part)"""


def _entities(spark, sf_dir):
    return load(spark, sf_dir, "part").selectExpr(
        "p_partkey entity_id", f"{_NAME} name", f"{_KIND} kind", "concat('d', p_size % 5) document_id", "case when p_partkey % 7 < 5 then p_brand end description"
    )


@query(f"""WITH {_E}, g AS (SELECT kind, lower(name) AS key, count(*) AS n FROM e GROUP BY 1, 2 HAVING count(*) > 1),
b AS (SELECT *, lower(name) AS key, row_number() OVER (PARTITION BY kind, lower(name) ORDER BY length(coalesce(description, '')) DESC, entity_id) AS r FROM e),
d AS (SELECT kind, key, left(string_agg(description, ' | ' ORDER BY place), 2000) AS description FROM (SELECT kind, lower(name) AS key, description, min(entity_id) AS place FROM e WHERE description IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT entity_id AS canonical_id, kind, name, CAST(n AS BIGINT) AS n, d.description FROM g JOIN b USING (kind, key) LEFT JOIN d USING (kind, key) WHERE r = 1""")
def exact_stage(spark, sf_dir):
    return resolution.exact_groups(_entities(spark, sf_dir))


_SUB = f"""{_E}, m AS (SELECT entity_id, {_NORM.format(x="name")} AS name, kind, document_id FROM e WHERE kind NOT IN ('SANCTION', 'DEADLINE', 'SECTION', 'REQUIREMENT')),
sub AS (SELECT a.entity_id AS short_id, b.entity_id AS long_id, a.kind, a.document_id FROM m a JOIN m b ON a.kind = b.kind AND a.document_id = b.document_id AND length(a.name) < length(b.name)
AND contains(b.name, a.name) AND length(a.name) >= 0.4 * length(b.name) AND len(string_split(a.name, ' ')) >= 2)"""


@query(f"WITH {_SUB} SELECT short_id, long_id FROM sub")
def substring_stage(spark, sf_dir):
    return resolution.substring_candidates(_entities(spark, sf_dir))


@query(f"""WITH {_SUB}, walk AS (SELECT list_reduce(list([{{'s': short_id, 'l': long_id}}] ORDER BY least(short_id, long_id), greatest(short_id, long_id)),
  lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.l = x[1].s OR y.l = x[1].l)) = 0 THEN list_concat(acc, x) ELSE acc END) AS taken FROM sub GROUP BY kind, document_id)
SELECT t.s AS short_id, t.l AS long_id FROM (SELECT unnest(taken) AS t FROM walk)""")
def substring_merges(spark, sf_dir):
    """Longer names merged into shorter ones, each entity away once at most."""
    return resolution.substring_merges(_entities(spark, sf_dir))


def _pairs(grams: str, where: str, rows: str = "e") -> str:
    return f"""n AS (SELECT *, {grams} AS g FROM {rows}), p AS (SELECT a.entity_id AS id1, b.entity_id AS id2, a.name AS name1, b.name AS name2,
len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))) AS s FROM n a JOIN n b ON a.kind = b.kind AND a.entity_id < b.entity_id AND {where})"""


@query(f"""WITH {_E}, {_pairs(_PG, "a.kind <> 'REQUIREMENT'")} SELECT id1, id2, round(s, 6) AS similarity FROM p WHERE round(s, 6) > 0.75 ORDER BY round(s, 6) DESC, id1, id2 LIMIT 200""")
def letter_stage(spark, sf_dir):
    """Pairs of one kind by trigrams, the 200 most similar."""
    return resolution.letter_candidates(_entities(spark, sf_dir))


_WORDS_OF = "list_distinct(list_filter(string_split({x}, ' '), lambda w: w <> ''))"
_W1, _W2 = (_WORDS_OF.format(x=_NORM.format(x=n)) for n in ("name1", "name2"))


@query(f"""WITH {_E}, {_pairs(_PG, "a.document_id = b.document_id AND a.kind NOT IN ('SANCTION', 'DEADLINE', 'SECTION', 'REQUIREMENT')")},
top AS (SELECT *, round(s, 6) AS similarity FROM p WHERE round(s, 6) >= 0.3 AND round(s, 6) <= 0.75 ORDER BY round(s, 6) DESC, id1, id2 LIMIT 500)
SELECT id1, id2, similarity FROM top WHERE len(list_intersect({_W1}, {_W2})) / len(list_distinct(list_concat({_W1}, {_W2}))) > 0.6""")
def word_stage(spark, sf_dir):
    """Of the 500 most similar pairs within a window of trigram similarity those that share most words."""
    return resolution.word_candidates(_entities(spark, sf_dir))


_RULES = f"""{_E}, k AS (SELECT *, {_NORM.format(x="name")} AS key FROM e),
c AS (SELECT key, kind, min(entity_id) OVER w AS ord, entity_id, name, row_number() OVER (PARTITION BY key, kind ORDER BY length(coalesce(description, '')) DESC, length(name) DESC, entity_id) AS r FROM k WINDOW w AS (PARTITION BY key, kind)),
cc AS (SELECT key, kind, ord, entity_id, name FROM c WHERE r = 1), {_pairs(_PY, "true", "cc")},
o AS (SELECT p.*, x.ord AS ord1, y.ord AS ord2, CASE WHEN length(name1) <> length(name2) THEN length(name1) > length(name2) ELSE x.ord < y.ord END AS stays FROM p JOIN cc x ON x.entity_id = id1 JOIN cc y ON y.entity_id = id2 WHERE round(s, 6) > 0.7),
f AS (SELECT CASE WHEN stays THEN id2 ELSE id1 END AS a, max_by(CASE WHEN stays THEN id1 ELSE id2 END, (least(ord1, ord2), greatest(ord1, ord2))) AS b FROM o GROUP BY 1),
walk(a, b, n) AS (SELECT a, b, 0 FROM f UNION ALL SELECT walk.a, f.b, n + 1 FROM walk JOIN f ON f.a = walk.b),
ends AS (SELECT a, max_by(b, n) AS final FROM walk GROUP BY 1),
merges AS (SELECT k.entity_id, k.name, k.kind, coalesce(final, cc.entity_id) AS canonical_id FROM k JOIN cc ON cc.key = k.key AND cc.kind = k.kind LEFT JOIN ends ON ends.a = cc.entity_id),
named AS (SELECT merges.*, e.name AS canonical FROM merges JOIN e ON e.entity_id = canonical_id)"""


@query(f"WITH RECURSIVE {_RULES} SELECT entity_id, name, kind, canonical_id, canonical FROM named")
def name_merges(spark, sf_dir):
    """Where names end that are merged by rule alone."""
    return resolution.name_merges(_entities(spark, sf_dir))


@query(f"""WITH RECURSIVE {_RULES}, final AS (SELECT name, max_by(canonical, entity_id) AS canonical FROM named GROUP BY 1),
rel AS (SELECT a.entity_id AS relation_id, a.name AS source, b.name AS target, a.kind FROM e a JOIN e b ON b.entity_id = a.entity_id + 1),
moved AS (SELECT relation_id, coalesce(s.canonical, source) AS source, coalesce(t.canonical, target) AS target, kind FROM rel LEFT JOIN final s ON s.name = source LEFT JOIN final t ON t.name = target)
SELECT relation_id, source, target, kind FROM moved WHERE source <> target QUALIFY row_number() OVER (PARTITION BY lower(source), lower(target), kind ORDER BY relation_id) = 1""")
def merged_name_relations(spark, sf_dir):
    """Relations between names after these are merged."""
    e = _entities(spark, sf_dir)
    then = e.select((F.col("entity_id") - 1).alias("relation_id"), F.col("name").alias("target"))
    relations = e.selectExpr("entity_id relation_id", "name source", "kind").join(then, "relation_id")
    return resolution.merged_relations(relations, resolution.name_merges(e))
