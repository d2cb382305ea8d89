"""Entity resolution: groups of equal names, similar pairs, merging, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.lineage import cut, stored
from docquarry.operators.components import connected_components

#: A share of a whole number may come out this much too large in floating point.
SLACK = 1e-9


def duplicate_groups(rows: DataFrame, key: Column, prefer: list[Column]) -> DataFrame:
    """(name_key, entity_type, canonical_id, canonical_name, n, entity_ids) of keys with two rows or more.

    rows has entity_id, name and entity_type; prefer are sort keys, smallest first, that choose the
    canonical row.
    """
    keyed = rows.withColumn("name_key", key)
    best = F.struct(*[p.alias(f"p{i}") for i, p in enumerate(prefer)], "entity_id", "name")
    groups = keyed.groupBy("name_key", "entity_type").agg(
        F.min(best).alias("best"), F.count("*").alias("n"), F.array_sort(F.collect_list("entity_id")).alias("entity_ids")
    )
    return groups.where("n > 1").select(
        "name_key", "entity_type", F.col("best.entity_id").alias("canonical_id"),
        F.col("best.name").alias("canonical_name"), "n", "entity_ids",
    )


def gram_pairs(rows: DataFrame, grams: Column, least: float, within: list[str] | None = None) -> DataFrame:
    """(id1, id2, similarity): pairs of rows (id, name) whose sets of grams have that Jaccard share.

    Rows meet through their grams, so that only pairs that share one are made; the shared ones are
    counted and the share follows from the sizes. A prefix of the grams in order of rarity is enough
    to meet at a given share, which keeps frequent grams out of the join.
    """
    within = within or []
    sized = cut(rows.select("id", *within, grams.alias("grams")).where("size(grams) > 0"))
    each = sized.select("id", *within, F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    rare = each.groupBy("gram").agg(F.count("*").alias("df"))
    order = Window.partitionBy("id").orderBy("df", "gram")
    # grams take a few bytes each in a shuffle and many more in memory, so none of the joins may become a broadcast
    prefix = each.join(rare.hint("merge"), "gram").withColumn("r", F.row_number().over(order))
    prefix = prefix.where(F.col("r") <= F.col("n") - F.ceil(F.lit(least) * F.col("n") - SLACK) + 1)
    left = prefix.select(F.col("id").alias("id1"), *within, "gram", F.col("n").alias("n1"))
    right = prefix.select(F.col("id").alias("id2"), *within, "gram", F.col("n").alias("n2"))
    met = left.join(right.hint("merge"), ["gram", *within]).where("id1 < id2")
    met = met.where(F.least("n1", "n2") >= F.lit(least) * F.greatest("n1", "n2")).select("id1", "id2").distinct()
    a = sized.select(F.col("id").alias("id1"), F.col("grams").alias("g1"))
    b = sized.select(F.col("id").alias("id2"), F.col("grams").alias("g2"))
    scored = met.join(a.hint("merge"), "id1").join(b.hint("merge"), "id2").select("id1", "id2", T.jaccard("g1", "g2").alias("similarity"))
    return scored.where(F.col("similarity") >= least).select("id1", "id2", F.round("similarity", 6).alias("similarity"))


def contained_pairs(rows: DataFrame, least_share: float = 0.4, min_words: int = 2) -> DataFrame:
    """(short_id, long_id, short, long): names that a longer name of the same kind contains, of that share of its
    length at least and with that many words. Rows are (id, name, kind).

    The shorter name looks for longer ones by the rarest of its pieces of a few letters within its kind, so that common
    beginnings bring nothing together. So many words have one letter each at least, and blanks between, which
    bounds the length of a piece. Null kinds are a kind of their own.
    """
    size = max(1, min(4, 2 * min_words - 1))
    pieces = F.expr(f"array_distinct(transform(sequence(1, greatest(length(name) - {size - 1}, 1)), i -> substr(name, i, {size})))")
    names = stored(rows.where(F.length("name") >= size).select("id", "name", F.struct("kind").alias("kind")))
    held = names.select("kind", "id", "name", F.explode(pieces).alias("piece"))
    often = held.groupBy("kind", "piece").agg(F.count("*").alias("n"))
    short = held.where(F.size(F.split("name", " ")) >= min_words)
    # nothing that grows with the input is broadcast: names take a few bytes each in their files and many pieces in memory
    rarest = short.join(often.hint("merge"), ["kind", "piece"]).groupBy("kind", "id", "name").agg(F.min(F.struct("n", "piece")).alias("m"))
    rarest = rarest.selectExpr("kind", "id short_id", "name short", "m.piece piece")
    met = rarest.join(held.selectExpr("kind", "id long_id", "name long", "piece").hint("merge"), ["kind", "piece"])
    fits = F.contains("long", "short") & (F.length("short") < F.length("long")) & (F.length("short") >= F.lit(least_share) * F.length("long"))
    return met.where(fits).select("short_id", "long_id", "short", "long")


def merge_map(links: DataFrame) -> DataFrame:
    """(entity_id, canonical_id) of all entities that links (id1, id2) join; the smallest id stays."""
    found = connected_components(links.select(F.col("id1").alias("src"), F.col("id2").alias("dst")))
    return found.select(F.col("node").alias("entity_id"), F.col("component").alias("canonical_id"))


def remapped_edges(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """edges (relationship_id, source, target, kind) after a merge: ends replaced, no self-loops, and
    of equal edges the one with the smallest id."""
    by_source = mapping.select(F.col("entity_id").alias("source"), F.col("canonical_id").alias("new_source"))
    by_target = mapping.select(F.col("entity_id").alias("target"), F.col("canonical_id").alias("new_target"))
    moved = edges.join(by_source, "source", "left").join(by_target, "target", "left").select(
        "relationship_id", F.coalesce("new_source", "source").alias("source"),
        F.coalesce("new_target", "target").alias("target"), "kind",
    )
    return (
        moved.where("source <> target")
        .groupBy("source", "target", "kind")
        .agg(F.min("relationship_id").alias("relationship_id"))
        .select("relationship_id", "source", "target", "kind")
    )


def _without(entries: Column, others: Column) -> Column:
    """The entries of a map whose keys another doesn't have."""
    return F.map_filter(entries, lambda k, _: ~F.map_contains_key(others, k))


def upserted(base: DataFrame, new: DataFrame, key: list[str], replace: list[str], fill: list[str] = (), union: list[str] = (), patch: list[str] = ()) -> DataFrame:
    """The state of base after new rows came: `replace` columns take the new value, `fill` columns
    the new value unless it is null, `union` columns the union of both arrays, `patch` columns, which are
    maps, the old entries with the new ones laid over them. Keys are unique on either side; null ones equal each other."""
    a, b = base.alias("a"), new.withColumn("_new", F.lit(True)).alias("b")
    joined = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key], "full_outer")
    here = F.col("b._new").isNotNull()
    columns = [F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in key]
    columns += [F.when(here, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in replace]
    columns += [F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) for c in fill]
    columns += [
        F.array_sort(F.array_union(F.coalesce(F.col(f"a.{c}"), F.array().cast(base.schema[c].dataType)),
                                   F.coalesce(F.col(f"b.{c}"), F.array().cast(base.schema[c].dataType)))).alias(c)
        for c in union
    ]
    for c in patch:
        none = F.create_map().cast(base.schema[c].dataType)
        old, late = F.coalesce(F.col(f"a.{c}"), none), F.coalesce(F.col(f"b.{c}"), none)
        columns.append(F.map_concat(_without(old, late), late).alias(c))
    return joined.select(*columns)


def resolved_edges(edges: DataFrame, names: DataFrame) -> DataFrame:
    """edges (relationship_id, document_id, source_name, target_name, kind) with entity ids: of the
    same document where the name is there, else the smallest of any; edges with an unknown end go."""
    own = names.groupBy("document_id", "name").agg(F.min("entity_id").alias("own"))
    anywhere = names.groupBy("name").agg(F.min("entity_id").alias("other"))
    out = edges
    for end in ("source", "target"):
        a = own.select("document_id", F.col("name").alias(f"{end}_name"), F.col("own").alias(f"{end}_own"))
        b = anywhere.select(F.col("name").alias(f"{end}_name"), F.col("other").alias(f"{end}_other"))
        out = out.join(a, ["document_id", f"{end}_name"], "left").join(b, f"{end}_name", "left")
        out = out.withColumn(end, F.coalesce(f"{end}_own", f"{end}_other")).drop(f"{end}_own", f"{end}_other")
    return out.where("source is not null and target is not null").select("relationship_id", "source", "target", "kind")
