"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order (by a hash of the id, so reruns and
other partitionings agree). A document's virtual finish time is the words of its queue up to and
with it, divided by the source's target. All targets add up to the budget, so the queues together
have served the budget at virtual time 1: sorting globally by virtual time and truncating at the
budget takes what starts before time 1, and cuts each queue's last document there. A queue whose
target exceeds its words is served again from its start, up to ``repeat`` times.

Words are runs without ASCII white space. Null and empty texts have size 0 and take 0. A null source
is a source of its own and comes last in the order of weights. Rows with equal ids and sizes go by a hash of
the text; each is taken on its own. An empty table gives an empty result. If the budget exceeds ``repeat``
times all words, every document is taken ``repeat`` times.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathgram.llm.common import SPACES, ranked, small, whole, word_count
from pathgram.session import materialise

WEIGHTS = (3, 1, 2)
#: Rows of a queue that one window may hold; longer queues are split by hash range.
BUCKET_ROWS = 4_000


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, repeat: int = 2) -> DataFrame:
    """Adds ``weight`` and ``target`` to a table (source, source_size).

    Targets are in proportion to the weights; one above ``repeat`` times its source's size stops
    there and its excess goes to the others by weight, until none is above.
    """
    by_code_point = [F.col("source").isNull(), F.col("source")]
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    sources = ranked(sources, by_code_point, "place", "mix-sources")
    sources = sources.withColumn("weight", F.get(cycle, F.pmod("place", F.lit(len(weights))).cast("int")).cast("double"))
    cap = F.col("source_size") * float(repeat)
    sources = materialise(sources, "mix-weights")
    total, weight = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    rest, level, stopped = share * total, 0.0, -1
    while weight > 0:
        level = rest / weight
        above = F.col("weight") * level > cap
        row = sources.agg(
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)),
            F.count(F.when(above, 1)),
        ).first()
        if row[2] == stopped:
            break
        rest, weight, stopped = share * total - row[0], row[1], row[2]
    above = F.col("weight") * level > cap
    fair = F.lit(rest) * F.col("weight") / F.lit(weight) if weight > 0 else cap
    return sources.withColumn("target", F.when(above, cap).otherwise(fair))


def fair_queue(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, repeat: int = 2, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, before, taken.

    ``before`` is the number of words ahead of the document in its queue; ``taken`` counts the
    words that the mix takes from it over all rounds. ``keep`` names further columns to carry.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.select("doc_id", "source", word_count(whole("text")).alias("size"), key.alias("key"), F.xxhash64("text").alias("tie"), *keep)
    rows = materialise(rows, "mix-rows")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    sources = materialise(source_targets(sources, weights, share, repeat), "mix-targets")
    side = small(sources.select(F.col("source").alias("source2"), "source_size", "rows", "target", "place"))
    rows = rows.join(side, F.col("source").eqNullSafe(F.col("source2"))).drop("source2")

    buckets = F.ceil(F.col("rows") / BUCKET_ROWS)
    lead = F.conv(F.substring("key", 1, 7), 16, 10).cast("long")
    rows = rows.withColumn("bucket", F.shiftright(lead * buckets, 28))
    ahead = Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("place", "bucket").agg(F.sum("size").alias("words"))
    offsets = offsets.select(
        F.col("place").alias("place2"), F.col("bucket").alias("bucket2"), F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("offset")
    )
    offsets = small(materialise(offsets, "mix-offsets"))
    inside = Window.partitionBy("place", "bucket").orderBy("key", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("size").over(inside))
    rows = rows.join(offsets, (F.col("place") == F.col("place2")) & (F.col("bucket") == F.col("bucket2")))
    rows = rows.withColumn("before", F.col("offset") + F.col("upto") - F.col("size"))
    limit = F.round("target").cast("long")
    taken = sum((_served(limit, F.col("before"), F.col("source_size"), turn) for turn in range(repeat)), F.lit(0).cast("long"))
    return rows.select("doc_id", "source", "size", "source_size", "target", "before", taken.alias("taken"), *keep)


def _served(limit: Column, before: Column, queue: Column, turn: int) -> Column:
    """Words of one document that are served in one round over its queue."""
    return F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), limit - before - queue * turn))


def _row_places(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` as a scan of files, and a frame of it with each row's place: file and number in the file.

    The place names a row whatever its values, in every reading of the same files. A frame that is not a scan of
    Parquet files is written first.
    """
    for table in (docs, None):
        table = materialise(docs, "mix-input") if table is None else table
        try:
            place = table.metadataColumn("_metadata")
            found = table.select(F.struct(*[table[f"`{c}`"] for c in table.columns]).alias("doc"), place["file_path"].alias("file"), place["row_index"].alias("number"))
            found.schema  # noqa: B018 - resolves the plan
            return table, found
        except AnalysisException:
            continue
    raise ValueError("rows cannot be told apart")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, repeat: int = 2) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, a row per served document and round, in order of virtual start.

    The document that a round ends in is cut after the last word that is served. Documents without
    words are left out. Every row is served by itself, also among repeated rows and rows without an id,
    so the words of the mix are those that ``fair_queue`` takes.
    """
    columns = docs.columns
    docs, placed = _row_places(docs)
    rows = placed.select(F.col("doc.doc_id").alias("doc_id"), F.col("doc.source").alias("source"), F.col("doc.text").alias("text"), "file", "number")
    queue = fair_queue(rows, weights, share, repeat, keep=("file", "number"))
    limit = F.round("target").cast("long")
    turns = F.array(*[
        F.struct(_served(limit, F.col("before"), F.col("source_size"), t).alias("served"), ((F.col("before") + F.col("source_size") * t) / F.col("target")).alias("start"))
        for t in range(repeat)
    ])
    queue = queue.filter("taken > 0").select(F.col("file").alias("file2"), F.col("number").alias("number2"), "size", turns.alias("turns"))
    queue = materialise(queue, "mix-served")
    served = placed.join(small(queue, 20_000), (F.col("file") == F.col("file2")) & (F.col("number") == F.col("number2")))
    served = served.select("doc", "size", F.explode("turns").alias("turn")).filter("turn.served > 0")
    text = F.col("doc.text")
    lead = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), 1, F.col("turn.served").cast("int")), "")
    served = served.withColumn("cut", F.when(F.col("turn.served") < F.col("size"), lead).otherwise(text))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    served = served.select("doc", "cut", F.col("turn.start").alias("start")).repartitionByRange(parts, "start", "doc.doc_id").sortWithinPartitions("start", "doc.doc_id")
    whole_length = F.length(whole("cut"))
    fields = {"text": F.col("cut")}
    if "n_chars" in columns:
        fields["n_chars"] = whole_length.cast(docs.schema["n_chars"].dataType)
    return served.select(*[fields.get(c, F.col("doc")[c]).alias(c) for c in columns])
