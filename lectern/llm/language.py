"""Language identification by compression with per-language zstandard dictionaries.

For every language a raw-content dictionary is put together from a bounded
sample of its labelled documents.  A text is encoded with each dictionary, in
blocks of the whole text, and the language whose dictionary gives the fewest
bytes is chosen.  The margin is how much smaller that is than the second best; a
narrow margin means the prediction is rejected.

Both sides see letters only: lower-cased, runs of anything else are one space.

Sample bound (documented parameter): `DICT_BYTES` per language in snippets of
`SNIPPET` characters, one from a document, from a place that a hash gives; all
dictionaries together at most `MODEL_BYTES`.  They are the only thing collected.

Defined results: null text or text without a letter is `und`, score 0; so is
every text if nothing can be learned; null lang or null doc_id is never learned
from; ties go to the language with more labelled documents, then by name;
repeated rows are predicted alike; an empty table gives no rows; only doc_id,
text and (for learning) lang are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import prepare

DICT_BYTES = 32 << 10
MODEL_BYTES = 32 << 20
SNIPPET = 256
BLOCK = 2048        # bytes of a text that are encoded at a time; smaller than a dictionary, so that it keeps its weight
LEVEL = 6
MIN_MARGIN = 0.005  # narrower margins are rejected
UNKNOWN = "und"
NOT_LETTERS = re.compile(r"[\W\d_]+")

Model = list[tuple[str, bytes]]


def letters(text: str) -> str:
    return NOT_LETTERS.sub(" ", text.lower())


def held_out(doc_id: Column) -> Column:
    """Documents kept out of learning: crc32 of the id as text leaves 1 when divided by 3 (null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, dict_bytes: int = DICT_BYTES) -> Model:
    """(language, dictionary content) from labelled documents that are not held out, most frequent language first.

    Two passes: label counts, then the snippets of the documents whose hash is
    below a threshold that leaves a few times as many as a dictionary takes.
    """
    known = docs.select("doc_id", "text", F.col("lang").alias("lang")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    totals = {r.lang: r.n for r in counts.orderBy(F.col("n").desc(), "lang").limit(MODEL_BYTES // (SNIPPET * 8)).collect()}
    if not totals:
        return []
    dict_bytes = min(dict_bytes, MODEL_BYTES // len(totals))
    want = max(1, dict_bytes // SNIPPET)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    sampled = known.join(F.broadcast(counts), "lang").withColumn("u", draw).where(F.col("u") < 4.0 * want / F.col("n"))
    place = F.lit(1) + F.pmod(F.xxhash64("doc_id", F.lit(7)), F.greatest(F.length("text") - SNIPPET, F.lit(0)) + 1).cast("int")
    from pyspark.sql import Window
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("u", "doc_id", "text"))
    rows = sampled.select("lang", "u", "doc_id", F.substring(F.col("text"), place, F.lit(SNIPPET)).alias("text")) \
        .withColumn("nth", nth).where(F.col("nth") <= want).orderBy("lang", "nth").collect()
    content: dict[str, list[str]] = {lang: [] for lang in totals}
    for r in rows:
        if r.lang in content:
            content[r.lang].append(letters(r.text))
    return [(lang, " ".join(parts).encode()[:dict_bytes]) for lang, parts in content.items() if parts]


def encoders(model: Model) -> list[zstandard.ZstdCompressor]:
    out = []
    for _, content in model:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def sizes(text: str | None, by_language: list[zstandard.ZstdCompressor]) -> list[int] | None:
    """Bytes of the encoded text with each dictionary; None if it has no letter."""
    seen = letters(text) if text else ""
    if not any(c.isalpha() for c in seen):
        return None
    raw = seen.encode()
    total = [0] * len(by_language)
    for at in range(0, len(raw), BLOCK):
        part = raw[at:at + BLOCK]
        for k, e in enumerate(by_language):
            total[k] += len(e.compress(part))
    return total


def classify(docs: DataFrame, model: Model, min_margin: float = MIN_MARGIN) -> DataFrame:
    """`docs` (all columns) with a struct column _lang: lang_pred, score, rejected.

    score is the margin: the share by which the best encoding is smaller than the second best (one language: 1).
    """
    names = [lang for lang, _ in model]

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        by_language = encoders(model)
        for texts in batches:
            out = []
            for t in texts:
                got = sizes(t, by_language) if names else None
                if got is None:
                    out.append((UNKNOWN, 0.0, True))
                    continue
                best = min(range(len(got)), key=got.__getitem__)
                second = min((x for k, x in enumerate(got) if k != best), default=None)
                margin = 1.0 if second is None else (second - got[best]) / second
                out.append((names[best], margin, margin < min_margin))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "rejected"]).astype({"lang_pred": object})

    return docs.withColumn("_lang", predict(F.col("text")))


def identified(docs: DataFrame, min_margin: float = MIN_MARGIN) -> DataFrame:
    """`docs` without those whose language is rejected (no letter, or too narrow a margin)."""
    prepare(docs.sparkSession)
    rows = classify(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("text")), learn(docs), min_margin)
    return rows.where(~F.col("_lang.rejected")).select("row.*")


def op7_language(docs: DataFrame) -> DataFrame:
    """The query's columns, and whether the prediction is rejected."""
    prepare(docs.sparkSession)
    rows = classify(docs.select("doc_id", "text"), learn(docs))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "_lang.*")
