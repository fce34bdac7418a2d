"""Licence statements in texts, by a paragraph classifier that templates confirm.

Paragraphs are lines, and runs of neighbouring lines in which a notice may be wrapped: a run has no line
without words, and its lines before the last have fewer words than the longest template. Where runs
overlap, each line goes by the one that has most of a template, then by the shortest; a run that has no more of a
template than a shorter one inside it does not count. Their features are the words and word pairs of the licence templates that hold at
least one word particular to licences. A multinomial logistic regression over these features tells
licence families from a class "none"; it is fitted to parts of the templates and to paragraphs without a
licence (at most ``SAMPLE_ROWS`` lines of the corpus, those with the smallest hash, and a few
sentences on other licences). A temperature, fitted to the part of that material that the regression
has not seen, calibrates its probabilities. A paragraph belongs to a family when its calibrated
probability is at least ``SURE`` and a template of that family shares at least ``SHARED`` of its pairs
with it; otherwise it has none.

A paragraph without any feature is none by definition, so only the others reach the model. A null text
counts as empty. Repeated rows are scanned each on their own. An empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathgram.llm.common import small, whole, words
from pathgram.session import materialise

SAMPLE_ROWS = 2_000
SURE = 0.5
SHARED = 0.5
TEMPERATURES = (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0)
NONE = "none"

# Short statements of well-known licences.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products",
        "Use of this source code is governed by a BSD-style license", "Released under the BSD License",
    ],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0"],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Licensed under CC BY-NC 4.0"],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Licensed under CC BY-SA 4.0"],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program", "Released under the GNU GPL version 2",
    ],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1", "This library is licensed under the GNU LGPL"],
    "mit": [
        "Released under the MIT License", "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License 2.0"],
    "public-domain": ["This is free and unencumbered software released into the public domain", "This work has been dedicated to the public domain under CC0 1.0"],
}
# Common words that say nothing about licences on their own.
COMMON = "a above all along an and any are as at be by can copy except following for form free from have in into is it its law list may met must nor not of on or out that the this to under use used use with you your file files program work works software library source terms name names person time"
# Sentences that speak of licences but grant none.
OTHERS = [
    "The driver must renew the license every ten years", "All rights reserved", "A fishing license is required by law", "The committee granted permission to build",
    "The museum is open to the general public", "She won a free ticket by public vote", "The version of the play was a success", "He attended MIT for two years",
    "The apache helicopter landed", "Copyright law is taught in the second term", "The foundation published a free report", "Creative minds meet on common ground",
]


def _pairs(tokens: list[str]) -> list[str]:
    return [*tokens, *(f"{a} {b}" for a, b in zip(tokens, tokens[1:]))]


def _tokens(text: str) -> list[str]:
    return [t for t in (re.sub(r"^[^a-z0-9]+|[^a-z0-9]+$", "", w) for w in text.lower().split()) if t]


def vocabulary() -> list[str]:
    """Words and word pairs of the templates with at least one word that is not common."""
    common = set(COMMON.split())
    return sorted({g for texts in TEMPLATES.values() for t in texts for g in _pairs(_tokens(t)) if not set(g.split()) <= common})


def _words(line: Column) -> Column:
    """Words of a line in lower case, without signs at their ends."""
    return F.filter(F.transform(words(F.lower(line)), lambda w: F.regexp_replace(w, r"^[^a-z0-9]+|[^a-z0-9]+$", "")), lambda w: w != "")


def paragraphs(docs: DataFrame) -> DataFrame:
    """Lines and runs of lines with at least one licence word that can have their share of a template: row, first, last, features."""
    pairs = {t: {g for g in _pairs(_tokens(t)) if " " in g} for texts in TEMPLATES.values() for t in texts}
    longest = max(len(_tokens(t)) for t in pairs)
    fewest = math.ceil(SHARED * min(map(len, pairs.values())))
    every = F.array(*[F.lit(g) for g in sorted({g for p in pairs.values() for g in p})])
    used = F.array(*[F.lit(g) for g in sorted({*vocabulary(), *(g for p in pairs.values() for g in p)})])
    marks = F.array(*[F.lit(w) for w in vocabulary() if " " not in w])
    # A word that is broken at its hyphen goes to the first of its lines as a whole.
    joined = F.regexp_replace(whole("text"), r"([A-Za-z]-)\n[^A-Za-z0-9\n]*([A-Za-z]\S*)", "$1$2\n")
    rows = docs.select("row", F.transform(F.split(joined, "\n", -1), _words).alias("tokens"))
    rows = rows.select("row", "tokens", F.transform("tokens", lambda t: F.arrays_overlap(t, marks)).alias("marked"))
    rows = rows.filter(F.exists("marked", lambda x: x))
    sizes = F.transform("tokens", lambda t: F.size(t))
    rows = rows.select("row", "tokens", "marked", sizes.alias("sizes"))
    # Lines that a run from line i can have: up to the first without words, or that which completes the longest template.
    start = F.struct(F.lit(0).alias("lines"), F.lit(0).alias("words"), F.lit(True).alias("open"))
    more = lambda a, n: F.when(a["open"] & (n > 0) & (a["words"] < longest), F.struct((a["lines"] + 1).alias("lines"), (a["words"] + n).alias("words"), F.lit(True).alias("open"))).otherwise(
        F.struct(a["lines"].alias("lines"), a["words"].alias("words"), F.lit(False).alias("open"))
    )
    reach = lambda i: F.aggregate(F.slice("sizes", i + 1, longest), start, more, lambda a: a["lines"])
    rows = rows.select("row", "tokens", "marked", F.transform("sizes", lambda n, i: reach(i)).alias("reach"))
    run = lambda i, k: F.struct(i.alias("first"), (i + k - 1).alias("last"), F.flatten(F.slice("tokens", i + 1, k)).alias("tokens"))
    runs = lambda r, i: F.when(r > 0, F.transform(F.filter(F.sequence(F.lit(1), r), lambda k: F.exists(F.slice("marked", i + 1, k), lambda x: x)), lambda k: run(i, k)))
    found = rows.select("row", F.explode(F.filter(F.transform("reach", runs), lambda x: x.isNotNull())).alias("runs")).select("row", F.explode("runs").alias("run"))
    found = found.select("row", "run.first", "run.last", F.array_intersect(_with_pairs(F.col("run.tokens")), used).alias("terms"))
    return found.filter(F.size(F.array_intersect("terms", every)) >= fewest)


def licensed_lines(runs: DataFrame) -> DataFrame:
    """row, at and family of the lines in licensed runs (row, first, last, shared, family)."""
    longest = max(len(_tokens(t)) for texts in TEMPLATES.values() for t in texts)
    near = Window.partitionBy("row").orderBy("first").rangeBetween(0, longest)
    own = runs.dropDuplicates(["row", "first", "last"])
    own = own.withColumn("near", F.collect_list(F.struct("first", "last", "shared")).over(near))
    inside = lambda x: (x["last"] <= F.col("last")) & ((x["first"] > F.col("first")) | (x["last"] < F.col("last"))) & (x["shared"] >= F.col("shared"))
    own = own.filter(~F.exists("near", inside)).select("row", F.explode(F.sequence("first", "last")).alias("at"), "first", "last", "shared", "family")
    best = F.min_by("family", F.struct(-F.col("shared"), F.col("last") - F.col("first"), F.col("first")))
    return own.groupBy("row", "at").agg(best.alias("family"))


def _with_pairs(tokens: Column) -> Column:
    pairs = F.when(F.size(tokens) > 1, F.zip_with(F.slice(tokens, 1, F.size(tokens) - 1), F.slice(tokens, 2, F.size(tokens)), lambda a, b: F.concat(a, F.lit(" "), b)))
    return F.array_distinct(F.concat(tokens, F.coalesce(pairs, F.array().cast("array<string>"))))


def training(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """family, terms: windows of the templates and lines without a licence."""
    rows = []
    for family, texts in TEMPLATES.items():
        for text in texts:
            tokens = _tokens(text)
            rows.append((family, tokens))
            rows += [(family, tokens[:i] + tokens[i + 1 :]) for i in range(len(tokens))]
            rows += [(family, ["on", "the", *tokens, "of", "it"])]
    rows += [(NONE, _tokens(t)) for t in OTHERS for _ in range(10)]
    common = [w for w in COMMON.split()]
    rows += [(NONE, [w]) for w in vocabulary() if " " not in w] + [(NONE, common[i : i + 6]) for i in range(len(common) - 6)]
    known = spark.createDataFrame(rows, "family string, tokens array<string>").select("family", _with_pairs(F.col("tokens")).alias("terms"))
    return known.unionByName(lines.select(F.lit(NONE).alias("family"), "terms"))


class Classifier:
    """The regression, its classes and its temperature."""

    def __init__(self, spark: SparkSession, lines: DataFrame):
        self.classes = [NONE, *sorted(TEMPLATES)]
        self.counts = CountVectorizerModel.from_vocabulary(vocabulary(), inputCol="terms", outputCol="__x")
        self.counts.setBinary(True)
        place = F.array_position(F.array(*[F.lit(c) for c in self.classes]), F.col("family")) - 1
        rows = self.counts.transform(training(spark, lines)).withColumn("label", place.cast("double"))
        rows = materialise(rows.withColumn("held", F.pmod(F.xxhash64("terms", "family"), F.lit(4)) == 0), "licence-training")
        settings = {"featuresCol": "__x", "regParam": 1e-3, "maxIter": 80, "family": "multinomial", "rawPredictionCol": "__r", "probabilityCol": "__p", "predictionCol": "__c"}
        self.model: LogisticRegressionModel = LogisticRegression(**settings).fit(rows.filter("NOT held").coalesce(1))
        held = self.logits(rows.filter("held"))
        right = F.get("logits", F.col("label").cast("int"))
        losses = [F.avg(_log_sum(F.col("logits"), t) - right / t) for t in TEMPERATURES]
        best = F.array(*losses)
        found = held.agg(best.alias("losses")).first()["losses"]
        self.temperature = min(zip(found, TEMPERATURES, strict=True))[1] if found and found[0] is not None else 1.0
        self.held = held

    def logits(self, rows: DataFrame) -> DataFrame:
        rows = rows if "__x" in rows.columns else self.counts.transform(rows)
        return self.model.transform(rows).withColumn("logits", vector_to_array("__r")).drop("__x", "__r", "__p", "__c")

    def judged(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with terms) and their family, or none, and the calibrated probability."""
        rows = self.logits(rows).withColumn("top", F.array_max("logits"))
        family = F.get(F.array(*[F.lit(c) for c in self.classes]), (F.array_position("logits", F.col("top")) - 1).cast("int"))
        sure = F.exp(F.col("top") / self.temperature - _log_sum(F.col("logits"), self.temperature))
        rows = rows.select(*[c for c in rows.columns if c not in ("logits", "top")], family.alias("guess"), sure.alias("probability"))
        shared = F.lit(0.0)
        for name, texts in TEMPLATES.items():
            shared = F.when(F.col("guess") == name, F.greatest(*[_coverage(F.col("terms"), t) for t in texts], F.lit(0.0))).otherwise(shared)
        known = (F.col("guess") != NONE) & (F.col("probability") >= SURE) & (shared >= SHARED)
        return rows.withColumn("shared", shared).withColumn("family", F.when(known, F.col("guess")).otherwise(F.lit(NONE)))


def _log_sum(logits: Column, temperature: float) -> Column:
    top = F.array_max(logits)
    return top / temperature + F.log(F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp((x - top) / temperature)))


def _coverage(terms: Column, template: str) -> Column:
    """Share of a template's word pairs that a paragraph has."""
    pairs = sorted({g for g in _pairs(_tokens(template)) if " " in g})
    return F.size(F.array_intersect(terms, F.array(*[F.lit(g) for g in pairs]))) / len(pairs)


def scan_licences(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_paragraphs, n_licensed, families (sorted, comma-joined; empty for none)."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.xxhash64("text").alias("code"), "text")
    kept = rows.select(F.struct("doc_id", "code").alias("row"), "text")
    found = materialise(paragraphs(kept), "licence-paragraphs")
    # A share of the lines that gives some times SAMPLE_ROWS, before the few that are taken get sorted.
    code = F.xxhash64("line")
    share = F.pmod(code, F.lit(max(1, docs.count()))) < SAMPLE_ROWS
    sample = docs.select(F.explode_outer(F.split(whole("text"), "\n", -1)).alias("line"))
    sample = sample.filter(share & ~F.lower("line").rlike("licen|copyright|permi|redistribut|domain"))
    sample = sample.orderBy(code, "line").limit(SAMPLE_ROWS).select(_words(F.col("line")).alias("tokens")).select(_with_pairs(F.col("tokens")).alias("terms"))
    classifier = Classifier(spark, materialise(sample, "licence-sample"))
    judged = classifier.judged(found).filter(F.col("family") != NONE)
    lines = licensed_lines(judged.select("row", "first", "last", "shared", "family"))
    by_row = lines.groupBy("row").agg(F.count(F.lit(1)).alias("n_licensed"), F.array_join(F.sort_array(F.collect_set("family")), ",").alias("families"))
    by_row = by_row.select(F.col("row.doc_id").alias("__id"), F.col("row.code").alias("__code"), "n_licensed", "families")
    lines = F.size(F.split(whole("text"), "\n", -1)).cast("long")
    out = rows.select("doc_id", "code", lines.alias("n_paragraphs"))
    out = out.join(small(materialise(by_row, "licence-rows")), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("code") == F.col("__code")), "left")
    return out.select("doc_id", "n_paragraphs", F.coalesce("n_licensed", F.lit(0)).cast("long").alias("n_licensed"), F.coalesce("families", F.lit("")).alias("families"))
