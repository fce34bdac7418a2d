"""Quality rules of documents, and of the hosts they come from.

``measure`` counts words, symbols and repetitions of every whole text with built-in functions only.
A document fails when it breaks a rule. Failures are aggregated by host (``source``); a beta prior,
fitted to the hosts by moments, shrinks their failure rates, so that a host with few documents is
judged like its peers. In a host whose shrunken rate reaches ``BAD_HOST`` the stricter limits of the
rules hold for every document; elsewhere the ordinary ones.

A null text has no words and fails. A null source is a host of its own. Rows that repeat are judged
each on their own, and alike. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathgram.llm.common import SPACE_CHARS, small, whole, words
from pathgram.session import materialise

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: Limits in percent of words (symbols) and of lines with a word (repeated lines): ordinary, strict.
SYMBOLS_PERCENT = (20, 10)
DUP_LINES_PERCENT = (50, 30)
#: Mean characters of a word, ordinary and strict: below, above.
WORD_CHARS = ((2, 20), (3, 12))
BAD_HOST = 0.5


def measure(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep``, and n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words (all long)."""
    text = F.col("__text")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    rows = docs.select(*keep, whole("text").alias("__text")).select(
        *keep,
        words(text).alias("__words"),
        (F.size(F.split(text, r"[#*$%&|<>]", -1)) - 1).cast("long").alias("n_symbols"),
        lines.alias("__lines"),
    )
    w = F.col("__words")
    grams = F.when(F.size(w) < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    )
    rows = rows.select(
        *keep,
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size("__lines").cast("long").alias("n_lines"),
        grams.alias("__grams"),
    )
    # Most texts repeat no window; only the others sort windows with their places.
    g = F.col("__grams")
    ordered = F.when(
        F.size(F.array_distinct(g)) < F.size(g), F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("gram"), i.alias("at"))))
    )
    rows = rows.select(*[c for c in rows.columns if c != "__grams"], ordered.alias("__ordered"))
    o = F.col("__ordered")
    rows = rows.select(*[c for c in rows.columns if c != "__ordered"], _repeated_places(o).alias("__at"))
    at = F.col("__at")
    last = F.size(at) - 1
    covered = F.aggregate(
        F.transform(at, lambda x, i: F.when(i < last, F.least(F.lit(3), F.get(at, i + 1) - x)).otherwise(F.lit(3))), F.lit(0), lambda a, x: a + x
    )
    return rows.select(*[c for c in rows.columns if c != "__at"], F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def _repeated_places(ordered: Column) -> Column:
    """Places of the windows that occur at least twice, ascending; null if there is none."""
    same = lambda x, i: x["gram"] == F.get(ordered, i)["gram"]
    near = F.filter(ordered, lambda x, i: F.coalesce(F.when(i > 0, same(x, i - 1)), F.lit(False)) | F.coalesce(same(x, i + 1), F.lit(False)))
    return F.sort_array(F.transform(near, lambda x: x["at"]))


def _flags(level: int) -> Column:
    """Whether a document breaks a rule that has an ordinary (0) and a strict (1) limit."""
    low, high = WORD_CHARS[level]
    return (
        (100 * F.col("n_symbols") > SYMBOLS_PERCENT[level] * F.col("n_words"))
        | (100 * F.col("n_dup_lines") > DUP_LINES_PERCENT[level] * F.col("n_lines"))
        | (F.col("word_chars") < low * F.col("n_words"))
        | (F.col("word_chars") > high * F.col("n_words"))
    )


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Prior (alpha, beta) of host failure rates by moments; ``hosts`` has ``n`` and ``failed``.

    The spread of the rates beyond binomial noise gives the prior's weight. Without such spread the
    weight is large and every host keeps the overall rate.
    """
    n, f = F.col("n").cast("double"), F.col("failed").cast("double")
    row = hosts.agg(F.sum(n), F.sum(f), F.sum(n * n), F.sum(f * f / n), F.count(F.lit(1))).first()
    total, failed, squares, scatter, k = (float(v or 0) for v in row)
    mean = failed / total if total else 0.5
    noise = mean * (1 - mean)
    free = total - (squares / total if total else 0) - (k - 1)
    within = ((scatter - mean * failed) / noise - (k - 1)) / free if noise > 0 and free > 0 else 0.0
    weight = 1 / min(max(within, 1e-4), 0.5) - 1
    return max(mean, 1e-6) * weight, max(1 - mean, 1e-6) * weight


def judge(docs: DataFrame, *keep: str) -> DataFrame:
    """Per row: ``keep``, the measures, base_failed, kept, and the host's host_docs, host_failed, host_rate."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words"]
    rows = measure(docs, *dict.fromkeys(("source", *keep)))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    rows = materialise(rows.withColumn("base_failed", base), "rules-measured")
    failed = F.col("base_failed") | _flags(0)
    hosts = rows.groupBy(F.col("source").alias("__host")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(failed, 1)).alias("failed"))
    hosts = materialise(hosts, "rules-hosts")
    alpha, beta = beta_prior(hosts)
    rate = (F.col("failed") + alpha) / (F.col("n") + alpha + beta)
    verdicts = small(hosts.select("__host", F.col("n").alias("host_docs"), F.col("failed").alias("host_failed"), rate.alias("host_rate")))
    rows = rows.join(verdicts, F.col("source").eqNullSafe(F.col("__host")), "left")
    kept = ~F.col("base_failed") & ~F.when(F.col("host_rate") >= BAD_HOST, _flags(1)).otherwise(_flags(0))
    return rows.select(*keep, *names, "base_failed", kept.alias("kept"), "host_docs", "host_failed", "host_rate")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose verdict is good, with their columns."""
    marked = docs.select("doc_id", "source", "text", F.xxhash64("text").alias("__code"))
    bad = judge(marked, "doc_id", "source", "__code").filter(~F.col("kept"))
    bad = bad.select(F.col("doc_id").alias("__id"), F.col("source").alias("__from"), F.col("__code").alias("__bad")).distinct()
    bad = small(materialise(bad, "rules-bad"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__from")) & (F.xxhash64("text") == F.col("__bad"))
    return docs.join(bad, same, "left_anti")
