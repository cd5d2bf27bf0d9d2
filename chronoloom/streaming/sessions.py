"""Session signals, as batch queries and as Structured Streaming.

Streams drop rows later than the watermark; batch queries over the same rows see all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATENESS = "1 hour"


def significance(tool: Column) -> Column:
    """How much a call of a tool means: writing most, reading least."""
    # Kinds of tools and their weight.
    return (
        F.when(tool.isin("Write", "Edit", "NotebookEdit"), 1.0).when(tool == "Bash", 0.5).when(tool.isin("Read", "NotebookRead"), 0.2).when(tool.isin("Grep", "Glob", "WebSearch", "WebFetch"), 0.3).otherwise(0.4)
    )


def session_state(events: DataFrame) -> DataFrame:
    """(session_id, calls, significance, last_tool): each session's number of tool calls, their mean significance and the last tool."""
    e = events.where("session_id is not null and tool_name is not null")
    return e.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("calls"), (F.sum(F.round(significance(F.col("tool_name")) * 10).cast("long")) / (10 * F.count(F.lit(1)))).alias("significance"), F.max_by("tool_name", F.struct("occurred_at", "event_id")).alias("last_tool")
    )


def discomfort(score: Column, significance_: Column) -> Column:
    """Whether an answer's approval seeking is too much: the less a call means, the more is allowed."""
    return score > 0.6 + (1 - significance_) * 0.2


def drift(history: DataFrame, last: int = 20) -> DataFrame:
    """(session_id, drift, level) over each session's last 20 events (created_at, event_id, event_type, score): the mean of its discomfort
    scores, at most 1; warn above 0.75, block above 0.9."""
    w = Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("event_id"))
    recent = history.withColumn("r", F.row_number().over(w)).where(F.col("r") <= last)
    d = recent.groupBy("session_id").agg(F.least(F.lit(1.0), F.coalesce(F.avg(F.when(F.col("event_type") == "discomfort", F.col("score"))), F.lit(0.0))).alias("drift"))
    return d.withColumn("level", F.when(F.col("drift") > 0.9, "block").when(F.col("drift") > 0.75, "warn").otherwise("ok"))


def concurrent(events: DataFrame, seconds: int = 300) -> DataFrame:
    """(session_id, kind): a session is a subagent if another one in its cwd was active within the seconds before its start.

    All rows of a directory in time order tell it in one window over a range; no range join.
    """
    e = events.where("session_id is not null").select("cwd", "session_id", F.unix_micros(F.col("occurred_at").cast("timestamp")).alias("us"), "event_id")
    # a session is active at all its events; collecting the few sessions of a range is a window over time
    w = Window.partitionBy("cwd").orderBy("us").rangeBetween(-seconds * 1_000_000, -1)
    seen = e.withColumn("before", F.min("session_id").over(w)).withColumn("after", F.max("session_id").over(w))
    first = seen.groupBy("session_id").agg(F.min_by(F.struct("before", "after"), F.struct("us", "event_id")).alias("f"))
    other = (F.col("f.before") != F.col("session_id")) | (F.col("f.after") != F.col("session_id"))
    return first.select("session_id", F.when(F.coalesce(other, F.lit(False)), "subagent").otherwise("primary").alias("kind"))


def session_spans(events: DataFrame, gap_seconds: int = 3600) -> DataFrame:
    """(session_id, span, first_us, last_us, n): a session's events cut where nothing happened for longer than the gap."""
    e = events.where("session_id is not null").select("session_id", "event_id", F.unix_micros(F.col("occurred_at").cast("timestamp")).alias("us"))
    w = Window.partitionBy("session_id").orderBy("us", "event_id")
    cut = F.when(F.col("us") - F.lag("us").over(w) > gap_seconds * 1_000_000, 1).otherwise(0)
    rows = e.withColumn("cut", cut).withColumn("span", F.sum("cut").over(w))
    return rows.groupBy("session_id", "span").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count(F.lit(1)).alias("n"))


def signal_rollup(signals: DataFrame, least: int = 3) -> DataFrame:
    """(session_id, kind, n, strongest, strongest_at): signals (session_id, kind, intensity, at) of a kind, if there are at least three."""
    g = signals.groupBy("session_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("intensity").alias("strongest"), F.max_by("at", F.struct("intensity", "at")).alias("strongest_at"))
    return g.where(F.col("n") >= least)


# ---- streams ------------------------------------------------------------------------------------------------------


def read_events(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stream of hook events from a folder of Parquet files, with event time in UTC and its watermark."""
    return spark.readStream.schema(schema).parquet(path).withColumn("at", F.col("occurred_at").cast("timestamp")).withWatermark("at", LATENESS)


def stream_tool_counts(events: DataFrame, window: str = "1 day") -> DataFrame:
    """(start, tool_name, n): calls per tool and tumbling window. A repeated event_id counts once within the watermark."""
    once = events.where("tool_name is not null").dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window("at", window).alias("w"), "tool_name").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "tool_name", "n")


def stream_sessions(events: DataFrame, gap: str = "1 hour") -> DataFrame:
    """(session_id, start, end, n): session windows that end after the gap without events."""
    s = events.where("session_id is not null").groupBy("session_id", F.session_window("at", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


THROTTLED = "session_id string, tool_name string, event_id long, n long, mode string"


def stream_throttle(events: DataFrame, normal: int = 3, reduced: int = 8) -> DataFrame:
    """Each call with its number in (session, tool) and mode, from state kept per key; the state of a key ends when event time has moved a
    day past its last call."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, last = (state.get[0], 0) if state.exists else (0, 0)
        for pdf in batches:
            pdf = pdf.sort_values(["at", "event_id"])
            k = n + pd.RangeIndex(1, len(pdf) + 1).to_numpy()
            n += len(pdf)
            last = max(last, int(pdf["at"].iloc[-1].timestamp() * 1000))
            mode = ["normal" if i <= normal else "reduced" if i <= reduced else "blocked" for i in k]
            yield pd.DataFrame({"session_id": key[0], "tool_name": key[1], "event_id": pdf["event_id"].to_numpy(), "n": k, "mode": mode})
        state.update((n,))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + 24 * 3600 * 1000)

    calls = events.where("session_id is not null and tool_name is not null").dropDuplicatesWithinWatermark(["event_id"]).select("session_id", "tool_name", "event_id", "at")
    return calls.groupBy("session_id", "tool_name").applyInPandasWithState(step, THROTTLED, "n long", "append", GroupStateTimeout.EventTimeTimeout)


def run_available(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Process all that is there and stop; the checkpoint makes a restart go on where it ended."""
    q = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
