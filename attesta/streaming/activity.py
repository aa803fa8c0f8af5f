"""Streaming forms of the activity reports: days, sessions, repeated deliveries and last values.

A stream of new files is read with a watermark, so state of past windows is let go; late rows
up to the watermark still count. ``drain`` runs a stream over what has arrived, then moves its
clock past the last window so that all is put out, with checkpoint, clock and output in the
cluster's shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators.sessions import session_key
from attesta.session import shared_folder

#: How late a row may be. Repeats have their first delivery's time, so they count as equally late.
LATE = "2 days"


def stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table as a stream of files; the schema is that of the files there."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def once(rows: DataFrame, key: str, at: str, watermark: str = LATE) -> DataFrame:
    """Each key's first delivery; state is kept as long as repeats may arrive."""
    return rows.withWatermark(at, watermark).dropDuplicatesWithinWatermark([key]).where(F.col(key).isNotNull())


def daily_calls(activity: DataFrame, watermark: str = LATE) -> DataFrame:
    """(day, tool, calls, failures) of tumbling days; repeated deliveries count once."""
    calls = once(activity.select("id", "at_ts", "tool", "ok"), "id", "at_ts", watermark)
    counted = calls.groupBy(F.window("at_ts", "1 day"), "tool").agg(F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("ok")).alias("failures"))
    return counted.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "tool", "calls", "failures")


def session_windows(activity: DataFrame, gap_seconds: int = 1800, watermark: str = LATE) -> DataFrame:
    """(session, started_at, ended_at, calls): stretches of a session without an idle gap.

    The rule is that of ``operators.sessions``: a call reaches from its start to ``gap_seconds``
    after its end, and calls that overlap so are one stretch. Repeated deliveries count once.
    """
    busy = F.greatest(F.coalesce("duration_ms", F.lit(0)), F.lit(0)).cast("long") * 1000
    timed = activity.select("id", session_key(F.col("session")).alias("session"), "at_ts", F.timestamp_micros(F.unix_micros("at_ts") - busy).alias("start"), busy.alias("busy")).where("session is not null")
    calls = once(timed, "id", "start", watermark)
    reach = F.make_interval(secs=((F.col("busy") + F.lit(gap_seconds * 1_000_000 + 1)) / F.lit(1_000_000).cast("decimal(10,0)")).cast("decimal(18,6)"))
    runs = calls.groupBy(F.session_window("start", reach).alias("w"), "session").agg(F.max("at_ts").alias("ended_at"), F.count(F.lit(1)).alias("calls"))
    return runs.select("session", F.col("w.start").alias("started_at"), "ended_at", "calls")


def last_values(rows: DataFrame, keys: list[str], value: str, at: str) -> DataFrame:
    """The latest value of each key: the state of a functional claim, which holds until the next and so has no watermark."""
    return rows.groupBy(*keys).agg(F.max_by(value, at).alias("value"), F.max(at).alias("since"))


def _run(result: DataFrame, mode: str, at: str, number: int) -> None:
    def put(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/part={number}/batch={k}")

    result.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()


def drain(spark: SparkSession, folder: str, name: str, at: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All that ``build`` makes of the stream of a table, in append mode.

    The stream also reads a folder of clock rows, which have a time in column ``at`` and
    nothing else. After the files that are there one such row, ten years on, is added: the
    watermark passes, the windows close, and the query's last run puts them out.
    """
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    table = spark.read.parquet(f"{folder}/{name}.parquet")
    last = table.agg(F.max(at).alias("last"))
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema]
    last.where("false").select(*blank).write.mode("append").parquet(f"{base}/clock")

    def source() -> DataFrame:
        clock = spark.readStream.schema(table.schema).parquet(f"{base}/clock")
        return stream(spark, folder, name).withColumn("tick", F.lit(False)).unionByName(clock.withColumn("tick", F.lit(True)))

    _run(build(source()), "append", base, 0)
    late = F.col("last") + F.expr("interval 10 years")
    marks = {f.name: F.lit(None).cast(f.dataType) for f in table.schema} | {at: late}
    for key in ("id", "session"):
        if key in marks:  # a row without key or session would be left out before it moves the clock
            marks[key] = F.lit(-1 if key == "id" else "clock").cast(table.schema[key].dataType)
    last.where("last is not null").select(*(c.alias(n) for n, c in marks.items())).write.mode("append").parquet(f"{base}/clock")
    _run(build(source()), "append", base, 1)
    out = build(stream(spark, folder, name))
    return spark.read.schema(out.schema).parquet(f"{base}/out/*/*").select(*out.columns)


def drain_latest(result: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The last row that an updating query has put out for each key."""
    base = f"{shared_folder(result.sparkSession)}/stream-{uuid.uuid4().hex}"
    _run(result, "update", base, 0)
    rows = result.sparkSession.read.schema(result.schema).parquet(f"{base}/out/*/*")
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), at).alias("row"))
    return newest.select("row.*")
