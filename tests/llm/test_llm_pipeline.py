"""The pipeline: every stage against a brute-force version of its decision."""

import os
import re

import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from lectern.llm import decontaminate, language, mixing, simhash
from test_llm_native import same_as_sql
from test_llm_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"
LOWER = {k: k + 32 for k in range(65, 91)}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def test_registered():
    names = list(entry.queries())
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)
    assert 4 <= len(pipeline.STAGES) <= 5


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before, kept = kept, stage(spark, kept, SF)
        if k < len(pipeline.STAGES) - 1:
            assert kept.columns == docs.columns, name
        kept = spark.createDataFrame(kept.collect(), kept.schema)
        ids = {r.doc_id for r in kept.select("doc_id").collect()} if k < 4 else None
        if name == "language ID":
            want = {r.doc_id for r in language.op7_language(before).where("not rejected").collect()}
            assert ids == want
        elif name == "SimHash near-dedup":
            groups = {}
            for r in simhash.near_duplicates(before, pipeline.SHINGLE, pipeline.MAX_BITS).collect():
                groups.setdefault(r.component_id, []).append(r.doc_id)
            assert sorted(ids) == sorted(min(g) for g in groups.values()) and kept.count() == len(groups)
            rows = before.select("doc_id", "text").collect()
            root = plain_components([plain_fingerprint(r.text, pipeline.SHINGLE) for r in rows], pipeline.MAX_BITS)
            plain = {}
            for r, k in zip(rows, root):
                plain[k] = min(plain.get(k, r.doc_id), r.doc_id)
            assert sorted(ids) == sorted(plain.values())
        elif name == "benchmark decontamination":
            items = spark.read.parquet(f"{SF}/benchmark.parquet")
            assert ids == {r.doc_id for r in decontaminate.op10_decontaminate(before, items).where("not contaminated").collect()}
            split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
            windows = {tuple(w[i:i + 10]) for r in items.collect() if (w := split(r.text)) for i in range(max(1, len(w) - 9))}
            lengths = {len(w) for w in windows}
            hit = lambda w: any(tuple(w[i:i + n]) in windows for n in lengths for i in range(len(w) - n + 1))
            assert ids == {r.doc_id for r in before.collect() if not hit(split(r.text))}
        elif name == "mixing to target weights":
            same_as_sql(spark, mixing.op2_mix(before), mixing.SQL, before)
            words = lambda df: sum(len(r.text.encode().split()) for r in df.collect())
            assert abs(words(kept) - 1.5 * words(before)) <= 0.04 * words(before)  # sources of ten documents
        else:
            seen = {d for r in kept.select("doc_ids").collect() for d in r.doc_ids}
            assert seen == {r.doc_id for r in before.where("text <> ''").select("doc_id").collect()}


def test_run_is_the_stages_in_turn(spark):
    rows = pipeline.run(spark, SF)
    assert rows.where("n_tokens > 0").count() > 0 and rows.columns[:2] == ["shard", "row"]
