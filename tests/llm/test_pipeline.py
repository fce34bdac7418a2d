"""The stages in a row, each against brute force on what its predecessor kept."""

import os
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(__file__))
from messy import words  # noqa: E402
from test_documents import brute_lines, brute_mix  # noqa: E402
from test_ngram_join import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from pathgram.llm.rules import judge  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs
        if name == "quality_rules":
            good = {r.doc_id for r in judge(before, "doc_id").filter("kept").collect()}
            assert {r.doc_id for r in docs.collect()} == good
        elif name == "line_dedup":
            want = brute_lines([(r.doc_id, r.text) for r in before.collect()])
            assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(want)
        elif name == "near_duplicates":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            want = {c for d, n, c in brute(rows, 5, 80) if n} | {d for d, n, c in brute(rows, 5, 80) if not n}
            assert {r.doc_id for r in docs.collect()} == want and docs.count() == len(want)
        elif name == "mixing":
            want = {d: taken for d, _, _, _, taken in brute_mix([(r.doc_id, r.text, r.source) for r in before.collect()]) if taken}
            got = Counter()
            for r in docs.collect():
                got[r.doc_id] += len(words(r.text))
            assert dict(got) == want
        if name != "packing":
            assert docs.columns == columns
    tokens = {}
    for p in docs.collect():
        tokens[p.doc_id] = tokens.get(p.doc_id, 0) + p.length
    assert set(tokens) == {r.doc_id for r in kept["mixing"].collect()}


def test_run_is_the_stages_in_a_row(spark):
    found = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(found.columns)
    assert found.groupBy("sequence_id").sum("length").filter("`sum(length)` > 4096").count() == 0
