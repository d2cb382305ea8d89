"""Functions of text columns, all of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters and what they fold to.
ACCENTED = "áàâäãåčçďéèêëěíìîïňñóòôöõřšťúùûüůýÿžÁÀÂÄÃÅČÇĎÉÈÊËĚÍÌÎÏŇÑÓÒÔÖÕŘŠŤÚÙÛÜŮÝŽ"
PLAIN = "aaaaaaccdeeeeeiiiinnooooorstuuuuuyyzAAAAAACCDEEEEEIIIINNOOOOORSTUUUUUYZ"


def folded(text) -> Column:
    """text in lower case without accents."""
    return F.lower(F.translate(text, ACCENTED, PLAIN))


def all_words(text) -> Column:
    """Words of the folded text in their order."""
    return F.filter(F.split(folded(text), "[^a-z0-9]+"), lambda w: w != "")


def lexemes(text) -> Column:
    """Different words of the folded text."""
    return F.array_distinct(all_words(text))


def matches_all(document, query) -> Column:
    """Whether the document has every lexeme of the query."""
    return F.size(F.array_except(query, document)) == 0


def normalized_name(name) -> Column:
    """Lower case, plain dashes, no quotes or brackets, - for - and / with the blanks around, single blanks."""
    out = F.lower(name)
    for pattern, new in (
        ("[–—]", "-"),
        ("[\"'„“”]", ""),
        (r"[()]", ""),
        (r"\s*[-/]\s*", "-"),
        (r",\s*", " "),
        (r"\s+", " "),
    ):
        out = F.regexp_replace(out, pattern, new)
    return F.trim(out)


def citation_number(text) -> Column:
    """The first number/year of a text, or null."""
    return F.nullif(F.regexp_extract(text, r"(\d+/\d{4})", 1), F.lit(""))


def _grams(padded: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3)))


def trigrams(text) -> Column:
    """Different three-letter pieces of the whole text with two blanks before and one behind."""
    return F.array_distinct(_grams(F.concat(F.lit("  "), F.lower(text), F.lit(" "))))


def word_trigrams(text) -> Column:
    """Different three-letter pieces of each word with two blanks before and one behind."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    return F.array_distinct(
        F.flatten(F.transform(words, lambda w: _grams(F.concat(F.lit("  "), w, F.lit(" ")))))
    )


def words(text) -> Column:
    return F.array_distinct(F.filter(F.split(text, " +"), lambda w: w != ""))


def jaccard(a, b) -> Column:
    """Shared share of two arrays of different values; 0 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


def html_text(html) -> Column:
    """Visible text: no scripts, styles or tags, five entities resolved, single blanks."""
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(out, "<[^>]+>", " ")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def without_fences(text) -> Column:
    """text without a code fence at its start and its end."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[a-z]*\s*", ""), r"\s*```$", ""))


def verdict(text) -> Column:
    """Whether an answer says yes: its JSON field `verdict`, else that pattern, else how it starts."""
    plain = without_fences(text)
    parsed = F.get_json_object(plain, "$")
    field = F.upper(F.trim(F.coalesce(F.get_json_object(plain, "$.verdict"), F.lit(""))))
    found = F.upper(F.regexp_extract(plain, r'(?i)"verdict"\s*:\s*"(YES|NO)"', 1))
    return (
        F.when(parsed.isNotNull() & F.startswith(F.ltrim(plain), F.lit("{")), field == "YES")
        .when(found != "", found == "YES")
        .otherwise(F.coalesce(F.startswith(F.upper(F.ltrim(plain)), F.lit("YES")), F.lit(False)))
    )


def without_thoughts(text) -> Column:
    """text without its <think> blocks, closed or cut off."""
    out = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    return F.trim(F.regexp_replace(out, r"(?s)<think>.*$", ""))


# Patterns of secrets and what takes their place, in order.
SECRETS = (
    (r"(?i)sk-ant-[a-zA-Z0-9_-]{32,}", "sk-ant-***"),
    (r"(?i)sk-[a-zA-Z0-9]{32,}", "sk-***"),
    (r"(?i)pa-[a-zA-Z0-9_-]{32,}", "pa-***"),
    (r"(?i)api[_-]?key[=:]\s*[a-zA-Z0-9_-]{20,}", "api_key=***"),
    (r"(?i)Bearer\s+[a-zA-Z0-9_-]{20,}", "Bearer ***"),
    (r"(?i)(password|pwd)[=:]\s*[a-zA-Z0-9_-]{8,}", "$1=***"),
)
# Prefixes of keys, the more special first, and the length that a valid key exceeds.
KEY_PREFIXES = ("sk-ant-", "sk-", "pa-")
KEY_LENGTHS = {"sk-ant-": 40, "sk-": 40, "pa-": 30}
OTHER_KEY_LENGTH = 20


def sanitized(text) -> Column:
    """text with secrets masked."""
    for pattern, new in SECRETS:
        text = F.regexp_replace(text, pattern, new)
    return text


def masked_key(key) -> Column:
    """The prefix of a key and stars; stars alone for other keys, empty ones and nulls."""
    out = F.lit("***")
    for prefix in reversed(KEY_PREFIXES):
        out = F.when(F.startswith(key, F.lit(prefix)), F.lit(prefix + "***")).otherwise(out)
    return out


def key_is_valid(key, prefix: str | None = None) -> Column:
    """Whether a key has its provider's prefix and more characters than the least."""
    if prefix is None:
        return F.coalesce(F.length(key) > OTHER_KEY_LENGTH, F.lit(False))
    return F.coalesce(F.startswith(key, F.lit(prefix)) & (F.length(key) > KEY_LENGTHS[prefix]), F.lit(False))


def page_id(document, page) -> Column:
    return F.format_string("%s_p%03d", document, page)


def page_parts(column) -> tuple[Column, Column]:
    """Document and page number of a page id; null where it has another form."""
    document = F.nullif(F.regexp_extract(column, r"^(.*)_p(\d+)$", 1), F.lit(""))
    return document, F.nullif(F.regexp_extract(column, r"^(.*)_p(\d+)$", 2), F.lit("")).try_cast("int")


def display_name(document) -> Column:
    """`Sb_YYYY_N_...` as `N/YYYY Sb.`; otherwise underscores become blanks."""
    form = r"^Sb_(\d{4})_(\d+)(_.*)?$"
    return F.when(F.rlike(document, F.lit(form)), F.regexp_replace(document, form, "$2/$1 Sb.")).otherwise(
        F.replace(document, F.lit("_"), F.lit(" "))
    )


def fallback_title(text, size: int = 50) -> Column:
    """A title of `size` characters at most before the dots, cut at a blank in its second half if
    there is one."""
    text = F.trim(text)
    head = F.substr(text, F.lit(1), F.lit(size))
    at_word = F.when(F.contains(head, F.lit(" ")), F.regexp_extract(head, r"(?s)^(.*) [^ ]*$", 1)).otherwise(head)
    cut = F.when(F.length(at_word) < size // 2, F.substr(text, F.lit(1), F.lit(size - 3))).otherwise(at_word)
    return F.when(F.length(text) <= size, text).otherwise(F.concat(cut, F.lit("...")))


def pruned(text, most: int = 300, head: int = 150, tail: int = 100) -> Column:
    """Long texts cut to their start and end with a mark between."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(
        F.length(text) > most,
        F.concat(F.substr(text, F.lit(1), F.lit(head)), F.lit(" [...pruned...] "), F.right(text, F.lit(tail))),
    ).otherwise(text)


def estimated_tokens(text) -> Column:
    """A quarter of the characters, rounded up, at least 1."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("int")


def safe_filename(name) -> Column:
    """Every sign but letters, digits, - and . becomes _, and runs of _ one."""
    return F.regexp_replace(F.regexp_replace(name, r"[^a-zA-Z0-9_\-.]", "_"), "_+", "_")


def main_question(text) -> Column:
    """What stands before a line that starts with `Guideline:`; single line ends and blanks."""
    out = F.trim(F.split(text, r"(?i)\n\s*guideline:", 2)[0])
    out = F.regexp_replace(F.regexp_replace(out, r"\n{2,}", "\n"), r"[ \t]+", " ")
    return F.trim(F.replace(out, F.lit("\u00a0"), F.lit(" ")))


def numbered_marks(text) -> Column:
    """All numbers between bars, those too large for a long left out."""
    return F.array_compact(F.transform(F.regexp_extract_all(text, F.lit(r"\|(\d+)\|"), 1), lambda x: x.try_cast("long")))


# Passwords that are refused.
COMMON_PASSWORDS = (
    "password", "123456", "12345678", "qwerty", "abc123", "monkey", "1234567", "letmein", "trustno1", "dragon",
    "baseball", "iloveyou", "master", "sunshine", "ashley", "bailey", "passw0rd", "shadow", "123123", "654321",
    "superman", "qazwsx", "michael", "football", "welcome",
)


def password_errors(password) -> Column:
    """Names of the rules that a password breaks."""
    rules = (
        ("length", F.length(password) < 8),
        ("upper", ~F.rlike(password, F.lit("[A-Z]"))),
        ("lower", ~F.rlike(password, F.lit("[a-z]"))),
        ("digit", ~F.rlike(password, F.lit("[0-9]"))),
        ("sign", ~F.rlike(password, F.lit(r"[@$!%*?&]"))),
        ("common", F.lower(password).isin(*COMMON_PASSWORDS)),
        ("repeated", F.rlike(password, F.lit(r"(.)\1{2,}"))),
    )
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules]))


def occurrences(text, needle: str) -> Column:
    """How often a literal occurs in the folded text, without overlaps."""
    plain = folded(text)
    found = folded(F.lit(needle))
    return ((F.length(plain) - F.length(F.replace(plain, found, F.lit("")))) / F.length(found)).cast("int")


def visible_ratio(text) -> Column:
    """The share of the words of an answer that are left without its thoughts, to 4 places; 0 for none."""
    count = lambda t: F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    return F.when(count(text) > 0, F.round(count(without_thoughts(text)) / count(text), 4)).otherwise(F.lit(0.0))


def _column(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def entity_text(name, kind, description) -> Column:
    """`name (kind): description`, for embedding."""
    return F.concat(_column(name), F.lit(" ("), _column(kind), F.lit("): "), F.coalesce(_column(description), F.lit("")))


def relation_text(source, kind, target, description) -> Column:
    """`source --[kind]--> target: description`, the last only where there is one."""
    arrow = F.concat(_column(source), F.lit(" --["), _column(kind), F.lit("]--> "), _column(target))
    return F.when(F.coalesce(description, F.lit("")) != "", F.concat(arrow, F.lit(": "), description)).otherwise(arrow)


# States that a requirement may have, and what an answer that can't be read counts.
STATES = ("MET", "UNMET", "PARTIAL", "UNCLEAR")
UNREAD = 0.25


def assessment(answer) -> tuple[Column, Column]:
    """(status, confidence) of an answer in JSON, with or without a fence.

    Other states, and answers that can't be read, are UNCLEAR; confidence is held within 0 and 1.
    """
    parsed = F.from_json(without_fences(answer), "status string, confidence double", {"mode": "PERMISSIVE"})
    status = F.upper(F.trim(parsed["status"]))
    said = F.coalesce(parsed["confidence"], F.lit(UNREAD))  # first, as greatest passes over nulls
    confidence = F.least(F.lit(1.0), F.greatest(F.lit(0.0), said))
    return F.when(status.isin(*STATES), status).otherwise(F.lit("UNCLEAR")), confidence


_EXTRACTION = "entities array<struct<name string, type string>>, relationships array<struct<source string, target string, type string>>"


def extracted(answer, kinds: list[str]) -> Column:
    """{entities: [{name, kind}], edges: [{source, target, kind}]} of an extraction answer.

    Names are trimmed and kinds upper-cased; entities without a name or of other kinds go, and so do
    edges without a kind or whose ends aren't both among the entities. Answers that can't be read have none.
    """
    parsed = F.from_json(without_fences(answer), _EXTRACTION, {"mode": "PERMISSIVE"})
    entities = F.transform(parsed["entities"], lambda e: F.struct(F.trim(e["name"]).alias("name"), F.upper(F.trim(e["type"])).alias("kind")))
    entities = F.filter(entities, lambda e: (e["name"] != "") & e["kind"].isin(kinds))
    names = F.transform(entities, lambda e: e["name"])
    edges = F.transform(
        parsed["relationships"],
        lambda e: F.struct(F.trim(e["source"]).alias("source"), F.trim(e["target"]).alias("target"), F.upper(F.trim(e["type"])).alias("kind")),
    )
    edges = F.filter(edges, lambda e: F.array_contains(names, e["source"]) & F.array_contains(names, e["target"]) & (e["kind"] != ""))
    return F.struct(entities.alias("entities"), edges.alias("edges"))


def community_title(title, summary, most: int = 100) -> Column:
    """The first characters of a title; null unless title and summary are both there."""
    both = (F.coalesce(_column(title), F.lit("")) != "") & (F.coalesce(_column(summary), F.lit("")) != "")
    return F.when(both, F.left(_column(title), F.lit(most)))


def legal_id(text) -> tuple[Column, Column]:
    """Number and year of the first `number/year`, or nulls."""
    parts = [F.nullif(F.regexp_extract(text, r"(\d+)/(\d{4})", i), F.lit("")).try_cast("int") for i in (1, 2)]
    return parts[0], parts[1]


def sampled(key, share: float, seed: int) -> Column:
    """Whether a row is in a sample of that share; a seeded hash of its key decides, so it is the same on every run."""
    if share >= 1:
        return F.lit(True)
    drawn = F.left(F.md5(F.concat(F.lit(f"{seed}:"), _column(key).cast("string"))), F.lit(6))
    return drawn < F.lit(f"{-int(-share * (1 << 24) // 1):06x}")
