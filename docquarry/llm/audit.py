"""Filter interaction audit from a histogram of failure masks.

Built-in expressions give every text a mask of the conditions that it fails. A condition on repeats
needs the smallest doc_id of equal texts, which a grouped minimum by digest supplies. Rows then add up to
one cell for each mask, at most 2 ** n cells a part, and everything that the audit says of any order
of the filters is computed from the cells of a part alone.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.lineage import stored
from docquarry.llm.common import narrow
from docquarry.operators.skew import spread_join

#: Words are maximal runs of other characters than space, \t, \n, \v, \f and \r.
_WORDS = r"array_remove(split(text, '[ \t\n\u000b\u000c\r]+'), '')"

#: Failure conditions of a row with text (never null), words (array), n_words, n_distinct and `repeats`,
#: which says that a row with a smaller doc_id has the same text.
FILTERS = {
    "A": "n_words < 50",
    "B": "100 * n_distinct < 65 * n_words",
    "C": "100 * length(regexp_replace(text, '[^A-Z]+', '')) > 5 * length(text)",
    "D": "text rlike '[#$%&*|]'",
    "E": "repeats",
}


def failure_masks(docs: DataFrame, filters: dict[str, str] = FILTERS) -> DataFrame:
    """(doc_id, part, mask) of every row: bit k is set where the text fails the k-th condition.

    part is the row's source. Equal texts are found by their SHA-256. Rows without a doc_id repeat no
    other row and no other row repeats them; rows that share text and doc_id don't repeat each other.
    """
    own = [f"if({c}, {1 << k}, 0)" for k, c in enumerate(filters.values()) if c != "repeats"]
    rows = narrow(docs, "doc_id", "coalesce(source, '') part", "coalesce(text, '') text")
    rows = rows.selectExpr("*", f"{_WORDS} words")
    rows = rows.selectExpr("doc_id", "part", "text", "cast(size(words) as long) n_words", "cast(size(array_distinct(words)) as long) n_distinct")
    rows = rows.selectExpr("doc_id", "part", f"{' + '.join(own) or '0'} mask", "unhex(sha2(text, 256)) digest")
    repeats = [1 << k for k, c in enumerate(filters.values()) if c == "repeats"]
    if not repeats:
        return rows.select("doc_id", "part", "mask")
    rows = stored(rows)  # texts are read once
    groups = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    # only texts that occur again can repeat; the others need no row of the join
    again = groups.where("n > 1 and first is not null").select("digest", "first")
    met = spread_join(rows, again, "digest", kind="left")
    return met.selectExpr("doc_id", "part", f"mask + if(coalesce(doc_id > first, false), {sum(repeats)}, 0) mask")


def cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): rows of each part by mask, and those that labels call good or toxic;
    one label of several for a document is enough."""
    known = labels.groupBy("doc_id").agg(
        F.max(F.expr("int(coalesce(quality = 1, false))")).alias("good"), F.max(F.expr("int(coalesce(toxic = 1, false))")).alias("toxic")
    )
    met = masks.join(known, "doc_id", "left")
    return met.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum(F.expr("coalesce(good, 0)")).alias("good"), F.sum(F.expr("coalesce(toxic, 0)")).alias("toxic"))


def audited(counted: DataFrame, names: str) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) from
    the cells of each part, for all orders of the filters called `names`, a letter each."""
    n = len(names)
    masks = f"sequence(0, {(1 << n) - 1})"
    entries = F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic"))))  # 2 ** n at most
    rows = counted.groupBy("part").agg(entries.alias("found"))
    rows = rows.selectExpr("part", *(f"transform({masks}, m -> coalesce(found[m].{c}, 0L)) {c}" for c in ("n", "good", "toxic")))

    def total(column: str, when: str) -> str:
        return f"aggregate({masks}, 0L, (s, m) -> s + if({when}, {column}[m], 0L))"

    gone = "(m & bit) <> 0 and (m & before) = 0"
    # by filter and by the set of filters before it: all that an order can ask for
    asked = f"filter(flatten(transform(sequence(0, {n - 1}), f -> transform({masks}, b -> struct(f, shiftleft(1, f) bit, b before)))), x -> (x.before & x.bit) = 0)"
    each = rows.selectExpr("*", f"inline({asked})").selectExpr(
        "part", "f", "before", total("n", gone) + " removed", total("good", gone) + " good_lost", total("toxic", gone) + " toxic_lost",
        total("n", "(m & (before | bit)) = 0") + " kept", total("n", "(m & bit) <> 0 and (m & before) <> 0") + " redundant", "n[bit] unique_fails",
    )
    weights = ", ".join(str(factorial(k) * factorial(n - 1 - k)) for k in range(n))
    each = each.groupBy("part").agg(
        F.map_from_entries(F.collect_list(F.expr(f"struct(f * {1 << n} + before, struct(f, before, kept, removed, redundant, unique_fails, good_lost, toxic_lost))"))).alias("known")
    )  # n * 2 ** (n - 1) entries
    shapley = f"transform(sequence(0, {n - 1}), f -> aggregate(map_values(known), 0L, (s, x) -> s + if(x.f = f, x.removed * array({weights})[int(bit_count(x.before))], 0L)))"
    each = each.selectExpr("part", "known", f"{shapley} shapley")
    orders = ",".join("".join(p) for p in permutations(names))
    steps = each.selectExpr("*", f"explode(split('{orders}', ',')) filter_order").selectExpr("*", f"explode(sequence(1, {n})) step")
    place = lambda at: f"instr('{names}', substr(filter_order, {at}, 1)) - 1"
    before = f"if(step = 1, 0, aggregate(sequence(1, greatest(step - 1, 1)), 0, (s, i) -> s | shiftleft(1, {place('i')})))"
    steps = steps.selectExpr("part", "filter_order", "step", "shapley", f"{place('step')} f", f"known[({place('step')}) * {1 << n} + {before}] x")
    return steps.selectExpr(
        "part", "filter_order", "step", "x.kept", "x.removed", "x.redundant", "x.unique_fails", "x.good_lost", "x.toxic_lost", "shapley[f] shapley"
    )


def interaction_audit(docs: DataFrame, labels: DataFrame, filters: dict[str, str] = FILTERS) -> DataFrame:
    """What each filter removes in every order of the filters, for each source of docs.

    One row for each part (a source; null counts as the empty one), order and step. kept documents
    remain after the step and removed ones go there; redundant ones fail its filter but went before;
    unique_fails fail no other filter; good_lost and toxic_lost are removed ones that labels call so;
    shapley adds up what the filter removes over all orders. Null texts are empty. Rows that repeat
    count each time. An empty table gives no rows. Texts of any length are whole; nothing but masks and
    digests is shuffled. A few letters name the filters, as n filters have n! orders.
    """
    return audited(cells(failure_masks(docs, filters), labels), "".join(filters))
