"""Execution histories: filters, requests in flight, values filled in so far."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def errors_only(executions: DataFrame) -> DataFrame:
    """Executions that failed."""
    return executions.where("not success")


def since(rows: DataFrame, step_start: float, clock: str = "_mono") -> DataFrame:
    """Rows from a step's start on, without the internal clock."""
    return rows.where(F.col(clock) >= step_start).drop(clock)


def bounded(executions: DataFrame, most: int, key: str = "session_id", order: str = "step") -> DataFrame:
    """The last executions of each session."""
    by = Window.partitionBy(key).orderBy(F.desc(order))
    return executions.withColumn("__n", F.row_number().over(by)).where(F.col("__n") <= most).drop("__n")


def requests(log: DataFrame) -> DataFrame:
    """log (session_id, ts, kind, method, url, ...) of started, finished and failed requests as one row each: state pending,
    completed or failed, with its duration. An end belongs to the last start of the same method and url before it; an
    end without a start counts if it is a failure."""
    by = Window.partitionBy("session_id", "method", "url").orderBy("ts")
    rows = log.withColumns({"prev_kind": F.lag("kind").over(by), "prev_ts": F.lag("ts").over(by), "next_kind": F.lead("kind").over(by)})
    ended = rows.where("(kind = 'finished' and prev_kind = 'started') or kind = 'failed'")
    ended = ended.select("session_id", "method", "url", F.when(F.col("prev_kind") == "started", F.col("prev_ts")).alias("started"), F.when(F.col("kind") == "failed", "failed").otherwise("completed").alias("state"), F.when(F.col("prev_kind") == "started", F.col("ts") - F.col("prev_ts")).alias("duration"))
    open_ = rows.where("kind = 'started' and next_kind is null").select("session_id", "method", "url", F.col("ts").alias("started"), F.lit("pending").alias("state"), F.lit(None).cast("double").alias("duration"))
    return ended.withColumn("duration", F.col("duration").cast("double")).unionByName(open_)


def fills_so_far(fills: DataFrame) -> DataFrame:
    """fills (session_id, step, value) with all values up to each step, each once, in order."""
    first = F.row_number().over(Window.partitionBy("session_id", "value").orderBy("step")) == 1
    by = Window.partitionBy("session_id").orderBy("step", "value").rowsBetween(Window.unboundedPreceding, 0)
    marked = fills.withColumn("__new", F.when(first, F.col("value")))  # a value is collected once, however often it recurs
    return marked.withColumn("values", F.collect_list("__new").over(by)).drop("__new")


def carried_sections(referenced: DataFrame, before: DataFrame) -> DataFrame:
    """(page_id, section_id) of sections referenced now or carried from before, each once."""
    return referenced.select("page_id", "section_id").union(before.select("page_id", "section_id")).distinct()


def inside_marked(nodes: DataFrame, marked: DataFrame | Column) -> DataFrame:
    """Nodes that have a marked ancestor: in document order, those that the furthest end of a marked node before them
    covers. One window over the node table, no range join. What marks is a table of nodes (page_id, node_id), or a
    condition on the nodes themselves, which needs no join and reads the nodes once."""
    if isinstance(marked, Column):
        own = nodes.withColumn("__marked", marked)
    else:
        own = nodes.join(marked.select("page_id", "node_id", F.lit(True).alias("__marked")).distinct(), ["page_id", "node_id"], "left")
    by = Window.partitionBy("page_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    return own.withColumn("__reach", F.max(F.when(F.col("__marked"), F.col("subtree_end"))).over(by)).where(F.col("__reach") > F.col("node_id")).drop("__marked", "__reach")
