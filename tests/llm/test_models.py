"""Licences and site quality: held-out results and awkward rows."""

import os
import sys
import textwrap

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from messy import frame, messy_rows, ordered  # noqa: E402

from pathgram.llm.licences import TEMPLATES, Classifier, scan_licences  # noqa: E402
from pathgram.llm.site_quality import site_quality  # noqa: E402

SF = "/root/testdata/sf0.01"
NONE = "doc_id long, terms array<string>"


def test_licence_lines_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = {"Apache License": "apache", "MIT License": "mit", "GNU General": "gpl", "CC BY-NC": "cc-by-nc"}
    want = {r.doc_id: sorted({v for k, v in names.items() if k in r.text}) for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: r.families for r in scan_licences(docs).collect()}
    assert len(got) == len(want)
    assert {d: ",".join(v) for d, v in want.items()} == got


def test_licences_in_awkward_rows(spark):
    rows = [*messy_rows(), (900, "a text\nReleased under the MIT License.\nLicensed under CC BY 4.0", "s"), (901, "The driver must renew the license every year", "s")]
    rows += [(902, TEMPLATES["gpl"][1].upper(), None), (903, "We sell licensed fan goods, version 2.0 is out", "s")]
    got = scan_licences(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert by_id[900].families == "cc-by,mit" and by_id[900].n_licensed == 2 and by_id[900].n_paragraphs == 3
    assert by_id[902].families == "gpl"
    assert all(not r.families for r in got if r.doc_id not in (900, 902))
    assert scan_licences(frame(spark, [])).count() == 0


def test_wrapped_notices_of_every_family(spark):
    rows, want = [], {}
    for family, texts in TEMPLATES.items():
        text = max(texts, key=len)
        for width in (24, 40, 68):
            lines = textwrap.wrap(text, width)
            want[len(rows)] = (family, len(lines))
            rows.append((len(rows), "\n".join(["Some words come first here", "", *[f"# {x}" for x in lines], "", "and others end it"]), "s"))
    got = {r.doc_id: r for r in scan_licences(frame(spark, rows)).collect()}
    assert {d: r.families for d, r in got.items()} == {d: family for d, (family, _) in want.items()}
    assert all(r.n_licensed <= want[d][1] for d, r in got.items())


def test_classifier_on_held_out_paragraphs(spark):
    classifier = Classifier(spark, spark.createDataFrame([], "terms array<string>"))
    judged = classifier.judged(classifier.held.drop("logits").withColumnRenamed("family", "truth"))
    right = judged.agg(F.avg((F.col("guess") == F.col("truth")).cast("double"))).first()[0]
    assert right > 0.9
    # A template that has lost the one word that tells it apart may go astray; nothing else does.
    wrong = judged.filter("family <> 'none' AND family <> truth").count()
    assert wrong <= 0.05 * judged.filter("family <> 'none'").count()
    sure = judged.agg(F.avg("probability")).first()[0]
    assert abs(sure - right) < 0.1


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = site_quality(docs, labels.filter("pmod(xxhash64(doc_id), 2) = 0")).join(labels.filter("pmod(xxhash64(doc_id), 2) = 1"), "doc_id")
    rows = got.groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in rows}
    assert n.get((1, False), 0) <= 0.01 * n[(1, True)]
    assert n.get((0, True), 0) <= 0.15 * n[(0, False)]


def test_quality_of_awkward_rows(spark):
    df = frame(spark)
    labels = spark.createDataFrame([(100, 0), (101, None), (None, 1), (110, 1), (111, 1), (111, 0), (112, 0), (115, 1), (120, 1)], "doc_id long, quality int")
    got = site_quality(df, labels).collect()
    assert ordered((r.doc_id,) for r in got) == ordered((d,) for d, _, _ in messy_rows())
    assert all(0 <= r.p_good <= 1 and r.kept is not None for r in got)
    none = site_quality(df, labels.limit(0)).collect()
    assert all(abs(r.p_document - 0.5) < 1e-9 for r in none)
    assert site_quality(frame(spark, []), labels).count() == 0


def test_sparse_sites_are_shrunk(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    lone = docs.withColumn("source", F.when(F.col("doc_id") == 5, "lonely").otherwise(F.col("source")))
    r = site_quality(lone, labels).filter("doc_id = 5").first()
    overall = labels.agg(F.avg("quality")).first()[0]
    assert abs(r.p_path - overall) < 0.1
