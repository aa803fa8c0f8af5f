"""Sessions: stretches of activity without a long idle gap.

Events of one key are cut into time chunks, smaller ones where they are dense. Inside a chunk a window finds local stretches;
chunk summaries carry the latest end of all earlier chunks forward; adjacent partial
stretches are merged where the gap at their boundary is within the limit. Only the two
small windows over summaries run per key, so one key may hold most of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.session import settle

SPACES = r"(?U)^\s+|\s+$"
#: Most spans that a time chunk is cut into.
SPANS = 1 << 20


def session_key(session: Column) -> Column:
    """Lower case without surrounding whitespace; null where nothing is left."""
    return F.nullif(F.lower(F.regexp_replace(session, SPACES, "")), F.lit(""))


def activity_intervals(activity: DataFrame) -> DataFrame:
    """key, id, tool, start_us, end_us of each call that has a session and a time.

    A call ends at ``at_ts`` and starts ``duration_ms`` earlier; null and negative durations
    count as 0. Calls without session or ``at_ts`` are left out.
    """
    end = F.unix_micros("at_ts")
    busy = F.greatest(F.coalesce(F.col("duration_ms"), F.lit(0)), F.lit(0)).cast("long") * 1000
    return activity.select(
        session_key(F.col("session")).alias("key"), F.col("id"), F.col("tool"), (end - busy).alias("start_us"), end.alias("end_us")
    ).where("key is not null and end_us is not null and id is not null")


def chunked(intervals: DataFrame, chunk_us: int, dense: int) -> DataFrame:
    """``intervals`` with their time chunk (in order of time); one of more than ``dense`` rows
    is cut into as many equal spans of time as would hold so many each.

    The dense chunks of all keys are at most rows / ``dense``, so their table is small; how
    it is joined is Spark's choice by its size.
    """
    coarse = F.floor(F.col("start_us") / chunk_us)
    full = intervals.groupBy("key", coarse.alias("coarse")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > dense)
    spans = full.select("key", "coarse", F.least(F.ceil(F.col("n") / dense), F.lit(min(chunk_us, SPANS))).alias("spans"))
    place = F.floor((F.col("start_us") - F.col("coarse") * chunk_us) * F.coalesce("spans", F.lit(1)) / chunk_us)
    return intervals.withColumn("coarse", coarse).join(spans, ["key", "coarse"], "left").withColumn("chunk", F.col("coarse") * SPANS + place).drop("coarse", "spans")


def partial_stretches(intervals: DataFrame, gap_us: int, chunk_us: int, dense: int) -> DataFrame:
    """Local stretches of each key and time chunk, with counts per tool.

    Repeated ids collapse here: copies share key and start, hence the chunk, so removing
    them needs no shuffle of its own.
    """
    placed = chunked(intervals, chunk_us, dense).repartition("key", "chunk").dropDuplicates(["key", "chunk", "id"])
    order = W.partitionBy("key", "chunk").orderBy("start_us", "id")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    numbered = (
        placed.withColumn("reach", F.max("end_us").over(before))
        .withColumn("cut", F.when(F.col("start_us") > F.col("reach") + gap_us, 1).otherwise(0))
        .withColumn("local", F.sum("cut").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    )
    per_tool = numbered.groupBy("key", "chunk", "local", F.coalesce("tool", F.lit("")).alias("tool")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct("start_us", "id")).alias("head"),
        F.max(F.struct("end_us", "id")).alias("tail"),
    )
    return per_tool.groupBy("key", "chunk", "local").agg(
        F.min("head").alias("head"),
        F.max("tail").alias("tail"),
        F.sum("n").alias("n"),
        F.collect_list(F.struct("tool", "n")).alias("tools"),
    )


def merge_stretches(partials: DataFrame, gap_us: int) -> DataFrame:
    """Join adjacent partial stretches of a key across chunk borders.

    A chunk's summary is its latest end and how many new stretches it opens; running
    maximum and sum over the summaries number the stretches of the whole key.
    """
    chunk_order = W.partitionBy("key").orderBy("chunk")
    earlier = chunk_order.rowsBetween(W.unboundedPreceding, -1)
    inside = W.partitionBy("key", "chunk").orderBy("local")
    reach = (
        partials.groupBy("key", "chunk")
        .agg(F.max("tail.end_us").alias("chunk_end"))
        .withColumn("carry", F.max("chunk_end").over(earlier))
        .select("key", "chunk", "carry")
    )
    opened = (
        partials.join(reach, ["key", "chunk"])
        .withColumn("seen", F.greatest("carry", F.max("tail.end_us").over(inside.rowsBetween(W.unboundedPreceding, -1))))
        .withColumn("opens", F.when(F.col("seen").isNull() | (F.col("head.start_us") > F.col("seen") + gap_us), 1).otherwise(0))
        .withColumn("nth", F.sum("opens").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)))
    )
    offsets = (
        opened.groupBy("key", "chunk")
        .agg(F.sum("opens").alias("chunk_opens"))
        .withColumn("base", F.coalesce(F.sum("chunk_opens").over(earlier), F.lit(0)))
        .select("key", "chunk", "base")
    )
    return opened.join(offsets, ["key", "chunk"]).withColumn("stretch", F.col("base") + F.col("nth"))


def sessionize(activity: DataFrame, gap_seconds: int = 1800, chunk_seconds: int = 21600, dense: int = 100_000) -> DataFrame:
    """One row per stretch: session, first_id, last_id, start, end, duration and counts.

    first_id is the call with the smallest (start, id), last_id that with the largest
    (end, id). ``tools`` lists "tool=count" in order of the tool's name; a null tool is "".
    An empty table gives no rows. Extra columns of the input are ignored.
    """
    gap_us = gap_seconds * 1_000_000
    partials = settle(partial_stretches(activity_intervals(activity), gap_us, chunk_seconds * 1_000_000, dense))
    merged = merge_stretches(partials, gap_us)
    stretches = merged.groupBy("key", "stretch").agg(
        F.min("head").alias("head"), F.max("tail").alias("tail"), F.sum("n").alias("calls")
    )
    tools = (
        merged.select("key", "stretch", F.explode("tools").alias("t"))
        .groupBy("key", "stretch", F.col("t.tool").alias("tool"))
        .agg(F.sum("t.n").alias("n"))
        .groupBy("key", "stretch")
        .agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "tool", F.col("n").cast("string")))), ",").alias("tools"))
    )
    return stretches.join(tools, ["key", "stretch"]).select(
        F.col("key").alias("session"),
        F.col("head.id").alias("first_id"),
        F.col("tail.id").alias("last_id"),
        F.timestamp_micros("head.start_us").alias("started_at"),
        F.timestamp_micros("tail.end_us").alias("ended_at"),
        (F.col("tail.end_us") - F.col("head.start_us")).alias("duration_us"),
        "calls",
        "tools",
    )


def session_bounds(activity: DataFrame, gap_seconds: int = 1800, chunk_seconds: int = 21600, dense: int = 100_000) -> DataFrame:
    """session, first_id, last_id of each stretch; see ``sessionize``."""
    gap_us = gap_seconds * 1_000_000
    partials = settle(partial_stretches(activity_intervals(activity).withColumn("tool", F.lit("")), gap_us, chunk_seconds * 1_000_000, dense))
    return (
        merge_stretches(partials, gap_us)
        .groupBy("key", "stretch")
        .agg(F.min("head").alias("head"), F.max("tail").alias("tail"))
        .select(F.col("key").alias("session"), F.col("head.id").alias("first_id"), F.col("tail.id").alias("last_id"))
        .distinct()
    )
