"""Small tables with every awkward case: nulls, empty and long texts, repeats, clashing columns."""

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def sentence(n: int, start: int = 0) -> str:
    return " ".join(WORDS[(start + i * i) % len(WORDS)] + str((start * 7 + i) % 31) for i in range(n))


ROWS = [
    (1, sentence(40), "en", "src0", 1),
    (2, sentence(40), "en", "src0", 2),
    (3, "", "en", None, None),
    (4, None, None, "src1", 0),
    (5, "  \t\n ", "de", "src1", 0),
    (6, sentence(3000, 5), "fr", "src0", 3),
    (None, sentence(25, 3), "en", "src0", 4),
    (None, None, None, None, None),
    (7, "one", "en", "src2", 1),
    (7, "one", "en", "src2", 1),
    (7, "two words", "es", "src2", 1),
    (8, "Ünïcode ßtraße — naïve 日本 \U0001f600 " * 30, "de", "src3", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Columns named like results or helpers of the operators.
CLASHING = ("n_words", "spans", "kept", "key", "id", "fp", "ord", "length", "part", "hash", "label", "score", "component")


def documents(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def clashing(spark, rows=ROWS):
    from pyspark.sql import functions as F

    return documents(spark, rows).select("*", *[F.lit(c).alias(c) for c in CLASHING])
