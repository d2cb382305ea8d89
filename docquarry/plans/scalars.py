"""Functions of text and numbers applied to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.functions import costs as C
from docquarry.functions import text as T
from docquarry.plans.registry import query
from docquarry.sources import load


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(trim(t), '^```[a-z]*\s*', ''), '\s*```$', '')) AS plain FROM (
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '```json' || chr(10) || lang || chr(10) || '```' WHEN 1 THEN '  ' || lang || ' ' ELSE lang END AS t FROM documents)""")
def fenced_answers(spark, sf_dir):
    answer = F.expr(r"case doc_id % 3 when 0 then concat('```json\n', lang, '\n```') when 1 then concat('  ', lang, ' ') else lang end")
    return load(spark, sf_dir, "documents").select("doc_id", T.without_fences(answer).alias("plain"))


#: Answers and such made of the columns of documents; both engines read these expressions.
_H = "md5(coalesce(text, ''))"
_SAID = f"CASE n_chars % 5 WHEN 0 THEN ' yes' WHEN 1 THEN 'YES ' WHEN 2 THEN 'no' WHEN 3 THEN substr({_H}, 1, 3) ELSE '' END"
_VERDICTS = f"""CASE doc_id % 4 WHEN 0 THEN '{{"verdict": "' || {_SAID} || '", "why": "' || source || '"}}' WHEN 1 THEN '```json ' || '{{"verdict": "' || {_SAID} || '"}} ```'
WHEN 2 THEN '{{"verdict": "' || {_SAID} || '", broken' ELSE {_SAID} || ', they are ' || source END"""


@query(f"""WITH a AS (SELECT doc_id, trim(regexp_replace(regexp_replace(trim({_VERDICTS}), '^```[a-z]*\\s*', ''), '\\s*```$', '')) AS t FROM documents)
SELECT doc_id, CASE WHEN starts_with(ltrim(t), '{{') AND json_valid(t) THEN upper(trim(json_extract_string(t, '$.verdict'))) = 'YES'
WHEN regexp_matches(t, '(?i)"verdict"\\s*:\\s*"(YES|NO)"') THEN upper(regexp_extract(t, '(?i)"verdict"\\s*:\\s*"(YES|NO)"', 1)) = 'YES' ELSE starts_with(upper(ltrim(t)), 'YES') END AS same FROM a""")
def merge_verdicts(spark, sf_dir):
    """Answers as JSON, as JSON in a fence, as broken JSON and as plain text."""
    return load(spark, sf_dir, "documents").select("doc_id", T.verdict(F.expr(_VERDICTS)).alias("same"))


_SECRET = f"""CASE doc_id % 6 WHEN 0 THEN 'sk-ant-' || {_H} || substr({_H}, 1, CAST(doc_id % 9 AS INT)) WHEN 1 THEN 'key sk-' || {_H} || substr('!a', 1, CAST(doc_id % 3 AS INT)) || ' end' WHEN 2 THEN 'PA-' || {_H} || '_x'
WHEN 3 THEN 'api_key=' || substr({_H}, 1, CAST(17 + doc_id % 7 AS INT)) WHEN 4 THEN 'pwd: ' || substr({_H}, 1, CAST(doc_id % 12 AS INT)) || ' Bearer ' || substr({_H}, 1, CAST(15 + doc_id % 9 AS INT)) ELSE source END || ' at ' || coalesce(lang, '-')"""


def _masked(x: str) -> str:
    for pattern, new in T.SECRETS:
        x = f"regexp_replace({x}, '{pattern}', '{new.replace('$1', chr(92) + '1')}', 'g')"
    return x


@query(f"SELECT doc_id, {_masked(_SECRET)} AS clean FROM documents")
def masked_errors(spark, sf_dir):
    """Messages with secrets of many lengths."""
    return load(spark, sf_dir, "documents").select("doc_id", T.sanitized(F.expr(_SECRET)).alias("clean"))


_KEYED = f"CASE n_chars % 5 WHEN 0 THEN 'sk-ant-' WHEN 1 THEN 'sk-' WHEN 2 THEN 'pa-' WHEN 3 THEN '' ELSE source END || substr({_H} || md5(source), 1, CAST(doc_id % 60 AS INT))"


@query(f"""WITH k AS (SELECT doc_id, {_KEYED} AS key FROM documents)
SELECT doc_id, CASE WHEN starts_with(key, 'sk-ant-') THEN 'sk-ant-***' WHEN starts_with(key, 'sk-') THEN 'sk-***' WHEN starts_with(key, 'pa-') THEN 'pa-***' ELSE '***' END AS masked,
starts_with(key, 'sk-ant-') AND length(key) > 40 AS valid, starts_with(key, 'pa-') AND length(key) > 30 AS valid_pa, length(key) > 20 AS long_enough FROM k""")
def masked_keys(spark, sf_dir):
    """Keys of many lengths, with and without the prefixes of providers."""
    key = F.expr(_KEYED)
    valid = [T.key_is_valid(key, "sk-ant-").alias("valid"), T.key_is_valid(key, "pa-").alias("valid_pa"), T.key_is_valid(key).alias("long_enough")]
    return load(spark, sf_dir, "documents").select("doc_id", T.masked_key(key).alias("masked"), *valid)


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(d, '^Sb_(\d{4})_(\d+)(_.*)?$') THEN regexp_replace(d, '^Sb_(\d{4})_(\d+)(_.*)?$', '\2/\1 Sb.') ELSE replace(d, '_', ' ') END AS name FROM (
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Sb_' || CAST(1990 + doc_id % 30 AS VARCHAR) || '_' || CAST(doc_id AS VARCHAR) || '_law' ELSE 'my_' || source || '_file' END AS d FROM documents)""")
def display_names(spark, sf_dir):
    name = F.expr("if(doc_id % 2 = 0, concat('Sb_', 1990 + doc_id % 30, '_', doc_id, '_law'), concat('my_', source, '_file'))")
    return load(spark, sf_dir, "documents").select("doc_id", T.display_name(name).alias("name"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(url, '[^a-zA-Z0-9_\-.]', '_', 'g'), '_+', '_', 'g') AS name FROM pages""")
def safe_filenames(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", T.safe_filename("url").alias("name"))


@query(r"""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(rtrim(left(text, 40), ' ' || chr(10)), '\n{2,}', chr(10), 'g'), '[ \t]+', ' ', 'g')) AS question FROM conversations""")
def main_questions(spark, sf_dir):
    """The question before its guideline."""
    asked = F.concat(F.left("text", F.lit(40)), F.lit("\n  Guideline: answer\nshortly"))
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", T.main_question(asked).alias("question"))


@query("""SELECT event_id, CAST(event_id AS VARCHAR) || ',' || CAST(user_id AS VARCHAR) AS marks FROM events""")
def snippet_marks(spark, sf_dir):
    marked = F.expr("concat('see |', event_id, '| and |', user_id, '| not |x|')")
    return load(spark, sf_dir, "events").select("event_id", F.array_join(T.numbered_marks(marked).cast("array<string>"), ",").alias("marks"))


_PASSWORD = f"CASE doc_id % 5 WHEN 0 THEN substr({_H}, 1, CAST(doc_id % 14 AS INT)) WHEN 1 THEN upper(substr({_H}, 1, 6)) || '!' || substr({_H}, 7, 3) WHEN 2 THEN 'Dragon' || substr('aaa!', 1, CAST(n_chars % 5 AS INT)) WHEN 3 THEN substr('Monkey', 1, CAST(n_chars % 7 AS INT)) ELSE '$$$' || source END"
_COMMON = ", ".join(f"'{p}'" for p in T.COMMON_PASSWORDS)
_RULES = " || ".join(
    f"CASE WHEN {rule} THEN ',{name}' ELSE '' END"
    for name, rule in (
        ("length", "length(p) < 8"), ("upper", "NOT regexp_matches(p, '[A-Z]')"), ("lower", "NOT regexp_matches(p, '[a-z]')"), ("digit", "NOT regexp_matches(p, '[0-9]')"),
        ("sign", "NOT regexp_matches(p, '[@$!%*?&]')"), ("common", f"lower(p) IN ({_COMMON})"),
        ("repeated", "len(list_filter(range(1, length(p) - 1), lambda i: substr(p, i, 1) = substr(p, i + 1, 1) AND substr(p, i, 1) = substr(p, i + 2, 1))) > 0"),
    )
)


@query(f"SELECT doc_id, substr({_RULES}, 2) AS errors FROM (SELECT doc_id, {_PASSWORD} AS p FROM documents)")
def password_rules(spark, sf_dir):
    """Every rule that a password breaks, in the order of the rules."""
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(T.password_errors(F.expr(_PASSWORD)), ",").alias("errors"))


_THOUGHT = "CASE turn % 4 WHEN 0 THEN '<think>' || coalesce(text, '') || '</think> ' || role || ' said' WHEN 1 THEN coalesce(text, '') || ' <think> cut ' || role WHEN 2 THEN coalesce(text, '') ELSE '<think>a</think>' || role || '<think>b c</think> ' || substr(coalesce(text, ''), 1, 30) END"


@query(f"""WITH a AS (SELECT conv_id, turn, {_THOUGHT} AS t FROM conversations), b AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(t, '(?s)<think>.*?</think>', '', 'g'), '(?s)<think>.*$', ''), '^ +| +$', '', 'g') AS said FROM a),
n AS (SELECT *, len(list_filter(string_split_regex(t, '\\s+'), lambda w: w <> '')) AS whole, len(list_filter(string_split_regex(said, '\\s+'), lambda w: w <> '')) AS seen FROM b)
SELECT conv_id, turn, said, CASE WHEN whole > 0 THEN round(seen / whole, 4) ELSE 0 END AS visible FROM n""")
def visible_answers(spark, sf_dir):
    """Answers without their thoughts, and the share of words that is left."""
    answer = F.expr(_THOUGHT)
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", T.without_thoughts(answer).alias("said"), T.visible_ratio(answer).alias("visible"))


@query("""SELECT p_partkey, p_name || ' (' || p_type || '): ' || p_brand AS embed_text, p_name || ' --[' || p_type || ']--> ' || p_brand || CASE WHEN p_size > 25 THEN ': ' || CAST(p_size AS VARCHAR) ELSE '' END AS relation_text FROM part""")
def embedding_texts(spark, sf_dir):
    note = F.expr("if(p_size > 25, cast(p_size as string), null)")
    return load(spark, sf_dir, "part").select(
        "p_partkey", T.entity_text("p_name", "p_type", "p_brand").alias("embed_text"), T.relation_text("p_name", "p_type", "p_brand", note).alias("relation_text")
    )


_ASSESSED = f"""CASE doc_id % 3 WHEN 0 THEN '{{"status": "' || {{0}} || '", "confidence": ' || CAST(n_chars % 15 AS VARCHAR(9)) || 'e-1}}' WHEN 1 THEN '```json {{"status": " ' || {{0}} || ' "}} ```' ELSE {{0}} || substr({_H}, 1, 4) END"""
_ASSESSED = _ASSESSED.replace("{0}", "CASE n_chars % 6 WHEN 0 THEN 'met' WHEN 1 THEN 'Partial' WHEN 2 THEN 'UNMET' WHEN 3 THEN 'unclear' WHEN 4 THEN source ELSE '' END")


@query(f"""WITH a AS (SELECT doc_id, trim(regexp_replace(regexp_replace(trim({_ASSESSED}), '^```[a-z]*\\s*', ''), '\\s*```$', '')) AS t FROM documents), j AS (SELECT doc_id, CASE WHEN json_valid(t) THEN t END AS j FROM a),
v AS (SELECT doc_id, upper(trim(json_extract_string(j, '$.status'))) AS s, CAST(json_extract_string(j, '$.confidence') AS DOUBLE) AS c FROM j)
SELECT doc_id, CASE WHEN s IN ('MET', 'UNMET', 'PARTIAL', 'UNCLEAR') THEN s ELSE 'UNCLEAR' END AS status, least(1.0, greatest(0.0, coalesce(c, 0.25))) AS confidence FROM v""")
def assessments(spark, sf_dir):
    """Answers as JSON with status and confidence; what can't be read is unclear at a quarter."""
    status, confidence = T.assessment(F.expr(_ASSESSED))
    return load(spark, sf_dir, "documents").select("doc_id", status.alias("status"), confidence.alias("confidence"))


_ANSWER = """'{"entities": [{"name": " ' || p_name || ' ", "type": "' || lower(p_type) || '"}, {"name": "' || p_brand || '", "type": "Small"}, {"name": "", "type": "ECONOMY"}], "relationships": [{"source": "' || p_name || '", "target": "' || CASE WHEN p_size % 3 = 0 THEN 'nobody' ELSE p_brand END || ' ", "type": "' || CASE WHEN p_size % 5 = 0 THEN '' ELSE 'cites' END || '"}]}'"""
_KINDS = ("ECONOMY", "SMALL", "STANDARD")
_PARSED = f"""a AS (SELECT p_partkey AS id, {_ANSWER} AS t FROM part), e AS (SELECT id, trim(json_extract_string(x, '$.name')) AS name, upper(trim(json_extract_string(x, '$.type'))) AS kind FROM (SELECT id, unnest(CAST(json_extract(t, '$.entities') AS JSON[])) AS x FROM a)),
kept AS (SELECT * FROM e WHERE name <> '' AND kind IN {_KINDS})"""


@query(f"WITH {_PARSED} SELECT id, name, kind FROM kept")
def extracted_entities(spark, sf_dir):
    """Entities of extraction answers: trimmed names, upper-case kinds of a list, others left out."""
    found = T.extracted(F.expr(_ANSWER), list(_KINDS))
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.explode(found.getField("entities")).alias("e")).selectExpr("id", "e.name name", "e.kind kind")


@query(f"""WITH {_PARSED}, r AS (SELECT id, trim(json_extract_string(t, '$.relationships[0].source')) AS source, trim(json_extract_string(t, '$.relationships[0].target')) AS target, upper(trim(json_extract_string(t, '$.relationships[0].type'))) AS kind FROM a)
SELECT id, source, target, kind FROM r WHERE kind <> '' AND source IN (SELECT name FROM kept WHERE kept.id = r.id) AND target IN (SELECT name FROM kept WHERE kept.id = r.id)""")
def extracted_edges(spark, sf_dir):
    """Edges of extraction answers, kept where both ends are among the entities of the answer."""
    found = T.extracted(F.expr(_ANSWER), list(_KINDS))
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.explode(found.getField("edges")).alias("e")).selectExpr("id", "e.source source", "e.target target", "e.kind kind")


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE nullif(left(text, 100), '') END AS title FROM documents""")
def community_titles(spark, sf_dir):
    """Titles of at most 100 characters where title and summary are both there."""
    summary = F.expr("if(doc_id % 4 = 0, '', source)")
    return load(spark, sf_dir, "documents").select("doc_id", T.community_title("text", summary).alias("title"))


_MODEL = f"CASE doc_id % 9 WHEN 0 THEN 'Claude-' || source WHEN 1 THEN 'x/GPT-' || lang WHEN 2 THEN source || '-o3-mini' WHEN 3 THEN 'gemini' WHEN 4 THEN 'Voyage-' || source WHEN 5 THEN 'text-embedding-' || source WHEN 6 THEN 'BAAI/' || source WHEN 7 THEN 'baai/' || source ELSE substr({_H}, 1, 6) END"


def _provider(embeds: bool) -> str:
    rules = [f"WHEN contains(lower(m), '{part}') THEN '{owner}'" for part, owner in C.PROVIDERS + C.EMBEDDERS * embeds]
    rules += [f"WHEN contains(m, '{part}') THEN '{owner}'" for part, owner in C.EMBEDDER_OWNERS * embeds]
    return f"CASE {' '.join(rules)} ELSE 'unknown' END"


@query(f"SELECT doc_id, {_provider(True)} AS embeds, {_provider(False)} AS answers FROM (SELECT doc_id, {_MODEL} AS m FROM documents)")
def providers(spark, sf_dir):
    """Who provides a model, as one that embeds and as one that answers."""
    model = F.expr(_MODEL)
    return load(spark, sf_dir, "documents").select("doc_id", C.provider(model, embeds=True).alias("embeds"), C.provider(model).alias("answers"))


@query("""SELECT event_id, CASE WHEN user_id % 2 = 0 THEN '10.0.0.' || CAST(event_id % 256 AS VARCHAR) ELSE '192.0.2.' || CAST(user_id % 256 AS VARCHAR) END AS client,
CASE event_type WHEN 'click' THEN '/chat' WHEN 'view' THEN '/docs' ELSE 'default' END AS route FROM events""")
def client_keys(spark, sf_dir):
    """The client and the route that a rate limit counts by: a forwarded address counts only from a trusted peer."""
    rows = load(spark, sf_dir, "events").selectExpr(
        "event_id", "concat(if(user_id % 2 = 0, '172.16.0.', '192.0.2.'), user_id % 256) peer", "concat(' 10.0.0.', event_id % 256, ' , 10.9.9.9') forwarded",
        "case event_type when 'click' then '/chat/stream' when 'view' then '/docs' else '/else' end path",
    )
    client = C.client_address("peer", "forwarded", F.startswith("peer", F.lit("172.16.")))
    return rows.select("event_id", client.alias("client"), C.route_of("path", ["/chat", "/docs"]).alias("route"))


@query("""SELECT doc_id, CAST(doc_id + 1 AS INTEGER) AS number, CAST(1990 + doc_id % 30 AS INTEGER) AS year FROM documents""")
def legal_ids(spark, sf_dir):
    name = F.expr("concat('Act No. ', doc_id + 1, '/', 1990 + doc_id % 30, ' Coll.')")
    number, year = T.legal_id(name)
    return load(spark, sf_dir, "documents").select("doc_id", number.alias("number"), year.alias("year"))


@query("""SELECT event_id, round(value * CASE WHEN value / 4 BETWEEN 15 AND 40 THEN value / 4 ELSE 23.5 END, 4) AS converted FROM events""")
def exchanged(spark, sf_dir):
    """Sums in another currency; rates out of bounds give way to the fallback."""
    return load(spark, sf_dir, "events").select("event_id", F.round(F.col("value") * C.bounded_rate(F.col("value") / 4), 4).alias("converted"))


@query("""SELECT event_id, round((floor(value) * 3.0 + user_id * 15.0 + event_id % 100 * 3.0 * 0.1 + event_id % 10 * 3.0 * 1.25) / 1e6, 10) AS cost,
round(floor(value) * 0.12 / 1e6, 10) AS embedding_cost FROM events""")
def call_costs(spark, sf_dir):
    """Costs of calls: reads of the cache cost a tenth, writes a quarter more; embeddings cost their input."""
    rows = load(spark, sf_dir, "events").selectExpr("event_id", "floor(value) i", "user_id o", "event_id % 100 r", "event_id % 10 w")
    return rows.select(
        "event_id", F.round(C.call_cost("i", "o", "r", "w", 3.0, 15.0), 10).alias("cost"), F.round(C.embedding_cost("i", 0.12), 10).alias("embedding_cost")
    )


@query("""SELECT doc_id FROM documents WHERE left(md5('42:' || CAST(doc_id AS VARCHAR)), 6) < '4ccccd'""")
def seeded_sample(spark, sf_dir):
    """A share of the rows by a seeded hash of their key, the same on every run; the feature is the sample."""
    return load(spark, sf_dir, "documents").where(T.sampled("doc_id", 0.3, 42)).select("doc_id")
