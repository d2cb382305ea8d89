import pytest
from pyspark.sql import functions as F

from docquarry.functions import text as T


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ('{"verdict": "YES"}', True),
        ('{"verdict": "no"}', False),
        ('```json\n{"verdict": "yes"}\n```', True),
        ('{"verdict": "YES"} because', True),
        ('{"other": 1}', False),
        ("Yes, the same", True),
        ("no", False),
        ("", False),
    ],
)
def test_verdict(spark, text, expected):
    assert value(spark, T.verdict(F.lit(text))) is expected


def test_names_and_secrets(spark):
    assert value(spark, T.normalized_name(F.lit("Zákon – č. (1),  „X“ / Y"))) == "zákon-č. 1 x-y"
    assert value(spark, T.citation_number(F.lit("zákon č. 134/2016 Sb."))) == "134/2016"
    assert value(spark, T.citation_number(F.lit("none"))) is None
    long = "a" * 40
    assert value(spark, T.sanitized(F.lit(f"sk-{long} password: secret-99x"))) == "sk-*** password=***"
    assert value(spark, T.masked_key(F.lit("sk-abc"))) == "sk-***"
    assert value(spark, T.masked_key(F.lit(None).cast("string"))) == "***"
    assert value(spark, T.display_name(F.lit("Sb_2016_134_x"))) == "134/2016 Sb."
    assert value(spark, T.display_name(F.lit("my_file"))) == "my file"
    assert value(spark, T.safe_filename(F.lit("a/b\\c  d?.pdf"))) == "a_b_c_d_.pdf"
    assert value(spark, T.main_question(F.lit("What  is\n\n\nthis?\n Guideline: no"))) == "What is\nthis?"
    assert value(spark, T.numbered_marks(F.lit("|1| and |22|"))) == [1, 22]
    assert value(spark, T.without_thoughts(F.lit("<think>a</think>yes<think>cut"))) == "yes"
    assert value(spark, T.password_errors(F.lit("aaab"))) == ["length", "upper", "digit", "sign", "repeated"]


def test_page_ids(spark):
    assert value(spark, T.page_id(F.lit("X_p1"), F.lit(7))) == "X_p1_p007"
    document, page = T.page_parts(F.lit("X_p1_p007"))
    assert (value(spark, document), value(spark, page)) == ("X_p1", 7)
    assert value(spark, T.page_parts(F.lit("bad"))[1]) is None


def test_two_kinds_of_trigrams_differ(spark):
    a, b = F.lit("red ring"), F.lit("ring red")
    assert value(spark, T.jaccard(T.word_trigrams(a), T.word_trigrams(b))) == 1
    assert value(spark, T.jaccard(T.trigrams(a), T.trigrams(b))) < 1
    assert value(spark, T.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 0


def test_numbers_that_are_too_large(spark):
    rows = spark.createDataFrame([("a_p99999999999", "|12|;|99999999999999999999|", "99999999999/2020")], "page string, marks string, law string")
    document, page = T.page_parts(F.col("page"))
    number, year = T.legal_id(F.col("law"))
    r = rows.select(document.alias("document"), page.alias("page"), T.numbered_marks("marks").alias("marks"), number.alias("number"), year.alias("year")).first()
    assert tuple(r) == ("a", None, [12], None, 2020)
