"""Where a phrase stands on the pages of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.functions.markup import plain_letters, unaccented
from docquarry.session import ship_package


def found_on_pages(pages: DataFrame, phrase: str, keep: list[str], text: str = "text") -> DataFrame:
    """(*keep, match_index): a row for each place of the phrase, numbered from 0 on its page, whatever the case and the accents;
    places don't overlap. keep are the columns that name a page. A phrase of no letters is nowhere."""
    ship_package(pages.sparkSession)
    phrase = plain_letters(phrase)
    if not phrase:
        return pages.select(*keep, F.lit(0).alias("match_index")).where("false")
    letters = pages.select(*keep, unaccented(text).alias("_t"))
    n = ((F.length("_t") - F.length(F.replace("_t", F.lit(phrase), F.lit("")))) / F.lit(len(phrase))).cast("int")
    counted = letters.select(*keep, n.alias("_n")).where("_n > 0")
    return counted.select(*keep, F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("match_index"))
