"""Shared small fixtures of the training-data operator tests."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))


def prose(seed: int, n: int = 80) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghilmnoprstu", k=r.randint(2, 9))) for _ in range(n))


def documents(spark, rows):
    """rows: (doc_id, text[, lang, source]); a few extra columns whose names operators use inside."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", 1) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    return df.withColumns({"th": F.lit("x"), "did": F.lit(None).cast("string"), "row": F.lit(1.5), "fp": F.lit(1), "k": F.lit("k"),
                           "size": F.lit("s"), "source_size": F.lit("s"), "e": F.lit(0), "t": F.lit("t"), "_s": F.lit(1)})


ODD = [(1, None, None, None), (None, "no id here at all", "en", None), (None, None, None, None), (2, ""), (3, " \n\t "), (4, "x"),
       (5, LONG), (6, prose(1)), (7, prose(1)), (7, prose(1)), (8, "é ß 😀     ﬁ"), (9, "a" * 100_000)]
