"""One-to-one matching of pairs by falling score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.lineage import discard, stored, tidied
from docquarry.operators import similarity

#: Pairs that a round of greedy_vectors keeps of each side, or FEW for each row where these are more.
KEPT, FEW = 1 << 20, 32


def _mutual(by_left: DataFrame, by_right: DataFrame) -> DataFrame:
    """(left, right, score): pairs that come first both in the list of left and in that of right."""
    # of the highest score the smallest left, then the smallest right
    order = "struct(score, -left nl, -right nr)"
    left = by_left.groupBy("left").agg(F.max(F.expr(order)).alias("m")).selectExpr("left", "-m.nr right", "m.score")
    right = by_right.groupBy("right").agg(F.max(F.expr(order)).alias("m")).selectExpr("-m.nl left", "right", "m.score")
    return left.join(right, ["left", "right", "score"])


@tidied
def greedy_pairs(pairs: DataFrame) -> DataFrame:
    """(left, right, score): pairs taken by falling score, ties by left and right, while both ends are free.

    The order of pairs is strict, so a pair that comes first at both of its ends is taken whatever else
    happens. Every round takes all such pairs, two grouped maxima that agree, and removes the pairs whose
    ends are taken; this gives the pairs that one walk over the sorted list would. The first pair of what
    is left is always taken, so rounds end, and a chain of n falling scores needs n / 2 of them. Pairs with
    a null end or score say nothing; of equal pairs the highest score counts.
    """
    rest = pairs.where("left is not null and right is not null and score is not null")
    rest = stored(rest.groupBy("left", "right").agg(F.max("score").alias("score")))
    taken, held = None, []
    while not rest.isEmpty():
        now = stored(_mutual(rest, rest))
        held.append(now)
        left = stored(rest.join(now.select("left"), "left", "left_anti").join(now.select("right"), "right", "left_anti").select("left", "right", "score"))
        discard(rest)
        rest = left
    for now in held:
        taken = now if taken is None else taken.unionByName(now)
    return rest if taken is None else taken


@tidied
def greedy_vectors(
    left: DataFrame, right: DataFrame, least: float, id_col: str = "vec_id", vector: str = "embedding", kept: int = KEPT, few: int = FEW
) -> DataFrame:
    """(left, right, score): what greedy_pairs takes of all pairs of a row of left and one of right, ids that are unique in each, at a
    similarity of `least` or more.

    These pairs are never held. A round lists for each free row its most similar free rows of the other side. The first
    free row of a list that still has one comes before everything outside that list, so pairs that come first in both their
    lists are taken, time and again, until none is left. Only then are lists made anew for the rows that are
    still free. The first of all pairs is always taken, so rounds end. All pairs are still compared, and where
    most rows have the same few neighbours a round takes few pairs.
    """
    rest = [stored(df.select(id_col, vector).where(F.col(id_col).isNotNull())) for df in (left, right)]
    held = []
    while True:
        most = max(df.count() for df in rest)
        k = max(few, min(kept // max(most, 1), most))
        by_left = similarity.best_partners(rest[0], rest[1], k, least, id_col, vector).selectExpr("id1 left", "id2 right", "sim score")
        by_right = similarity.best_partners(rest[1], rest[0], k, least, id_col, vector).selectExpr("id2 left", "id1 right", "sim score")
        made = lists = [stored(by_left), stored(by_right)]
        taken = []
        while not (now := stored(_mutual(*lists))).isEmpty():
            taken.append(now)
            fewer = [stored(x.join(now.select("left"), "left", "left_anti").join(now.select("right"), "right", "left_anti").select(*x.columns)) for x in lists]
            if lists is not made:
                discard(*lists)
            lists = fewer
        if taken:
            # rows without a list have no partner left
            free = [
                stored(df.join(x.selectExpr(f"{end} {id_col}").distinct(), id_col, "left_semi").join(_all_of(taken).selectExpr(f"{end} {id_col}"), id_col, "left_anti"))
                for df, x, end in zip(rest, made, ("left", "right"))
            ]
        discard(*rest, *made)
        if not taken:
            return _all_of(held) if held else now
        discard(now, *lists)
        held += taken
        rest = free


def _all_of(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)
