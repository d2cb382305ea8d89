"""A table of odd rows for every operator on documents."""

from pyspark.sql import functions as F

SHARED = "a passage of well over fifty bytes, which three of the documents have in common"
LONG = " ".join(f"word{i % 977} number{i % 613}" for i in range(60_000))
ODD = [
    (900_001, None),
    (900_002, ""),
    (900_003, "   \n\t "),
    (900_004, "one"),
    (900_005, "one two"),
    (900_006, f"first {SHARED} and on"),
    (900_007, f"second {SHARED} {SHARED}\n{SHARED}"),
    (900_008, f"{SHARED}"),
    (900_009, "ÄÖÜ ß éa   x y \U0001f600 <|endoftext|> it's <b>"),
    (900_010, "ÄÖÜ ß éa   x y \U0001f600 <|endoftext|> it's <b>"),
    (900_011, "12345 !!! ... 999"),
    (900_012, LONG),
    (900_013, LONG + " and a little more"),
    (900_014, "x" * 70_000),
    (900_014, "x" * 70_000),
    (900_015, "mail ann@example.org or 10.0.0.1, card 4111 1111 1111 1111, call +1 (212) 555-0100 now"),
]
#: Names that the operators use inside.
CLASHES = ("h", "fp", "key", "lid", "line", "n", "word", "mask", "maybe", "keep", "rank", "bits", "component", "code")


def odd_rows(spark, docs):
    """The rows of docs with the odd ones behind them, and more columns."""
    rows = [(i, t, "en" if k % 2 else None, "odd", len(t or "")) for k, (i, t) in enumerate(ODD)]
    rows = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    return rows.withColumns({c: F.lit("clash") for c in CLASHES})


def texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def groups_of(pairs, nodes):
    """The smallest node of each component."""
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}
