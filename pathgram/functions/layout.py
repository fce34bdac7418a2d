"""Tasks of small scans, and size-checked broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL_ROWS = 10_000
#: Nodes that keep the splits of what they read.
PLAIN = {"ProjectExec", "FilterExec", "FileSourceScanExec", "BatchScanExec", "RangeExec", "LocalTableScanExec", "RDDScanExec",
         "ExternalRDDScanExec", "SerializeFromObjectExec", "InMemoryTableScanExec", "ColumnarToRowExec", "CoalesceExec"}


def _nodes(plan) -> list:
    """The plan's nodes, by walking its children."""
    children = plan.children()
    return [plan, *(n for k in range(children.size()) for n in _nodes(children.apply(k)))]


def splits(df: DataFrame) -> int | None:
    """Number of splits of a plain scan; None when the plan has stages (asking would run them)."""
    try:
        nodes = _nodes(df._jdf.queryExecution().sparkPlan())
        plain = all(n.getClass().getSimpleName() in PLAIN for n in nodes)
    except Exception:  # noqa: BLE001 - remote client without a JVM handle
        return None
    return df.rdd.getNumPartitions() if plain else None


def tasks(df: DataFrame) -> int | None:
    """Number of tasks that a scan, or the last exchange of a plan, is planned with; None if the plan does not say.

    Nothing is run. Adaptive execution may merge tasks later, so the figure is for choosing plans only.
    """
    found = splits(df)
    if found is not None:
        return found
    try:
        plan = df._jdf.queryExecution().executedPlan()
        if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            plan = plan.initialPlan()
        return plan.outputPartitioning().numPartitions() or None
    except Exception:  # noqa: BLE001
        return None


def spread(df: DataFrame) -> DataFrame:
    """Give every core work when a plain scan has fewer splits than cores.

    Such a table is small, so moving its rows once is cheap; larger scans are left as they are.
    """
    found = splits(df)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if found is not None and found < cores else df


def small_side(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """A derived per-key table as a broadcast side, if it proves small; otherwise unchanged.

    At most ``limit`` + 1 rows are looked at. A larger table stays distributed and the
    join is left to Spark.
    """
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
