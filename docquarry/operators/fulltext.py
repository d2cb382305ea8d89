"""Full-text search on an inverted index: a row for each lexeme of each document.

The index is a table (lexeme, doc_id, positions, weight), written in files that are sorted by lexeme
within hash buckets, so that a query reads the parts of files that may hold its lexemes and no text. Rows of
a frequent lexeme lie in many files, as documents are dealt over them too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.lineage import settings

# Fixed values of text-search ranking: the weights of the labels D, C, B and A, the last position that
# counts, how many positions of a lexeme are kept, and the sum of 1/n^2 by which occurrences are scaled.
WEIGHTS = {"D": 0.1, "C": 0.2, "B": 0.4, "A": 1.0}
LAST_POSITION, MOST_POSITIONS, SCALE = 16383, 255, 1.64493406685
#: Words further apart add nothing that a double could hold; the rank of words that are all so far apart.
FAR, LEAST_RANK = 100, 1e-20
#: Bytes of compressed texts that a task makes postings of.
PART = "8m"


def postings(rows: DataFrame, id_col: str, texts: dict[str, str], partitions: list[str] = ()) -> DataFrame:
    """(lexeme, <id>, *partitions, positions, labels) of rows: where each lexeme stands, counting all words, and the
    label of the text that it stands in. texts are {label: column}, read one behind the other; null ones are empty."""

    # rows of one document come together by their texts; its words, many times as many bytes, are put in order inside its row
    rows = rows.groupBy(id_col, *partitions).agg(F.collect_list(F.struct(*texts.values())).alias("texts"))

    def labelled(words: Column, label: str) -> Column:
        return F.transform(words, lambda w: F.struct(w.alias("lexeme"), F.lit(label).alias("label")))

    def words_of(row: Column) -> Column:
        both = [labelled(T.all_words(F.coalesce(row[column], F.lit(""))), label) for label, column in texts.items()]
        return F.transform(F.concat(*both), lambda x, i: F.struct(x["lexeme"].alias("lexeme"), F.least(i + 1, F.lit(LAST_POSITION)).alias("position"), x["label"].alias("label")))

    names = [id_col, *partitions]
    found = rows.select(*names, F.array_sort(F.flatten(F.transform("texts", words_of))).alias("e"))
    # places that come again, as those behind the last one do, count once
    found = found.select(*names, F.expr("filter(e, (x, i) -> i = 0 or x <> e[i - 1]) e"))
    found = found.select(*names, "e", F.expr("filter(sequence(1, size(e)), i -> size(e) > 0 and (i = 1 or e[i - 1].lexeme <> e[i - 2].lexeme)) starts"))
    last = f"least(coalesce(get(starts, j + 1), size(e) + 1), s + {MOST_POSITIONS}) - 1"
    each = f"transform(starts, (s, j) -> struct(e[s - 1].lexeme lexeme, transform(sequence(s, {last}), k -> e[k - 1]) held))"
    found = found.select(*names, F.explode(F.expr(each)).alias("p"))
    return found.select("p.lexeme", *names, F.col("p.held.position").alias("positions"), F.col("p.held.label").alias("labels"))


def write_index(index: DataFrame, path: str, id_col: str, files: int | None = None) -> DataFrame:
    """The postings as files sorted by lexeme, as many as given or as postings() dealt the documents to; documents are dealt
    over the files, so that no lexeme is too much for one."""
    dealt = index if files is None else index.repartition(files, F.xxhash64(id_col))
    dealt = dealt.sortWithinPartitions("lexeme", id_col)
    # a task's part of the texts is small enough for its postings to be sorted in memory
    with settings(index.sparkSession, {"spark.sql.adaptive.advisoryPartitionSizeInBytes": PART}):
        dealt.write.option("parquet.block.size", str(4 << 20)).parquet(path)
    return index.sparkSession.read.schema(index.schema).parquet(path)


def query_lexemes(spark: SparkSession, query: str) -> list[str]:
    """The different words of a query; it is one string that the caller gives."""
    return spark.range(1).select(T.lexemes(F.lit(query)).alias("q")).first().q


def match(index: DataFrame, id_col: str, query: str, keep: list[str] = ()) -> DataFrame:
    """(<id>, *keep) of documents with every word of the query; a query without words matches nothing."""
    lexemes = query_lexemes(index.sparkSession, query)
    if not lexemes:
        return index.select(id_col, *keep).where("false")
    hits = index.where(F.col("lexeme").isin(lexemes)).groupBy(id_col, *keep).agg(F.count("*").alias("n"))
    return hits.where(F.col("n") == len(lexemes)).select(id_col, *keep)


def _weight(label: Column) -> Column:
    out = F.lit(WEIGHTS["D"])
    for name in "CBA":
        out = F.when(label == name, F.lit(WEIGHTS[name])).otherwise(out)
    return out


def _single(entry: Column) -> Column:
    """Rank of one lexeme: its best weight, and the others by falling shares in the order of their places."""
    weights = F.transform(entry["labels"], lambda x: _weight(x))
    shares = F.transform(weights, lambda w, j: w / ((j + 1) * (j + 1)))
    best = F.array_max(weights)
    at = F.array_position(weights, best)
    return (best + F.aggregate(shares, F.lit(0.0), lambda s, x: s + x) - best / (at * at)) / SCALE


def _nearness(hits: DataFrame) -> DataFrame:
    """(k, left): what is left of 1 for each document k after all pairs of places of different lexemes within FAR of each other, the
    closer the less. Places meet in stretches of FAR words, each with its own and the neighbouring ones."""
    each = hits.select("k", "lexeme", F.explode(F.arrays_zip("positions", "labels")).alias("e"))
    each = each.select("k", "lexeme", F.col("e.positions").alias("at"), _weight(F.col("e.labels")).alias("w"))
    stretch = F.floor(F.col("at") / FAR)
    a = each.select("k", F.col("lexeme").alias("la"), F.col("at").alias("p"), F.col("w").alias("x"), F.explode(F.array(stretch - 1, stretch, stretch + 1)).alias("stretch"))
    b = each.select("k", F.col("lexeme").alias("lb"), F.col("at").alias("q"), F.col("w").alias("y"), stretch.alias("stretch"))
    met = a.join(b, ["k", "stretch"]).where(f"la < lb and p <> q and abs(p - q) <= {FAR}")
    worth = "sqrt(x * y / (1.005D + 0.05D * exp(abs(p - q) / 1.5D - 2)))"
    return met.groupBy("k").agg(F.exp(F.sum(F.expr(f"log1p(-{worth})"))).alias("left"))


def rank(index: DataFrame, id_col: str, query: str, keep: list[str] = (), digits: int = 6) -> DataFrame:
    """(<id>, *keep, rank) of documents with every word of the query.

    One word ranks by how often and in what text it stands. Several words rank by how close their
    places are, over all pairs of places of all pairs of words, as text search does by default; pairs
    of words that never stand within reach of each other leave the least rank.
    """
    lexemes = query_lexemes(index.sparkSession, query)
    names = [id_col, *keep]
    if not lexemes:
        return index.select(*names, F.lit(0.0).alias("rank")).where("false")
    hits = index.where(F.col("lexeme").isin(lexemes)).select(F.struct(*names).alias("k"), "lexeme", "positions", "labels")
    if len(lexemes) == 1:
        return hits.select("k.*", F.round(_single(F.struct("positions", "labels")), digits).alias("rank"))
    whole = hits.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") == len(lexemes)).select("k")
    score = 1 - F.coalesce("left", F.lit(1.0))
    score = F.when(score > 0, score).otherwise(F.lit(LEAST_RANK))
    return whole.join(_nearness(hits), "k", "left").select("k.*", F.round(score, digits).alias("rank"))
