"""Bloom filters as small tables: a word of 64 bits in each row, tested by a broadcast join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A filter never has more bits than this, whatever the input: 2 ** 21 words of 16 bytes are
#: broadcast at most. Beyond that it lets more rows through, which costs time and no result.
MAX_BITS = 1 << 27
BITS_PER_ROW = 32

_ONE = "shiftright({h}, 40) & 63"
_TWO = "shiftright({h}, 50) & 63"


def filter_words(rows: int) -> int:
    """Words of a filter for so many rows, a power of two."""
    bits = min(MAX_BITS, max(1 << 16, rows * BITS_PER_ROW))
    return 1 << ((bits // 64).bit_length() - 1)


def build(hashes: DataFrame, words: int, least: int = 1) -> DataFrame:
    """(word, bits) of the column h: the bits that at least `least` rows set. At most `words` rows."""
    one, two = _ONE.format(h="h"), _TWO.format(h="h")
    bits = hashes.selectExpr(f"h & {words - 1}L word", f"explode(array_distinct(array({one}, {two}))) bit")
    often = bits.groupBy("word", "bit").count().where(F.col("count") >= least)
    return often.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, cast(bit as int))) bits"))


def tested(rows: DataFrame, column: str, words: int, built: DataFrame) -> DataFrame:
    """rows with a boolean `maybe`: whether the filter has both bits of that hash column."""
    one, two = _ONE.format(h=column), _TWO.format(h=column)
    mask = f"shiftleft(1L, cast({one} as int)) | shiftleft(1L, cast({two} as int))"
    keyed = rows.withColumns({"word": F.expr(f"{column} & {words - 1}L"), "mask": F.expr(mask)})
    # built has at most `words` rows, which filter_words bounds
    return (
        keyed.join(F.broadcast(built), "word", "left")
        .withColumn("maybe", F.expr("coalesce(bits & mask = mask, false)"))
        .drop("word", "mask", "bits")
    )
