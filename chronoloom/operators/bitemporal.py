"""Predicates and queries over valid time, transaction time and lifecycle of nodes and edges.

Valid time is half-open: [t_valid_from, t_valid_until), null meaning without bound. active: never superseded and not archived.
Every function takes and returns DataFrames, ignores columns it doesn't name, and gives an empty result for an empty table.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000


def is_active() -> Column:
    return F.col("t_valid_until").isNull() & F.col("archived_at").isNull()


def edge_is_active() -> Column:
    return F.col("t_valid_until").isNull()


def valid_at(t: int) -> Column:
    """The half-open as-of predicate."""
    return (F.col("t_valid_from").isNull() | (F.col("t_valid_from") <= t)) & (F.col("t_valid_until").isNull() | (F.col("t_valid_until") > t))


def overlaps(from_a: str, until_a: str, from_b: str, until_b: str) -> Column:
    """Closed ranges overlap; null ends are without bound."""
    low, high = F.lit(-(2**62)), F.lit(2**62)
    return (F.coalesce(F.col(from_a), low) <= F.coalesce(F.col(until_b), high)) & (F.coalesce(F.col(from_b), low) <= F.coalesce(F.col(until_a), high))


def trusted_only() -> Column:
    """Leaves out external facts (tier 4); an unknown tier is left out too."""
    return F.col("trust_tier") < 4


def any_tag_like(part: str) -> Column:
    """Some tag contains the text, without regard to ASCII case."""
    return F.exists("tags", lambda x: F.lower(x).contains(part.lower()))


def kind_not_in(*kinds: str) -> Column:
    """A null kind passes."""
    return F.col("kind").isNull() | ~F.col("kind").isin(*kinds)


def any_keyword(words: list[str], columns: list[str]) -> Column:
    """Some word is in some column, without regard to case."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.lower(F.col(c)).contains(w.lower()), F.lit(False)) for w in words for c in columns])


def parse_moment(text: str, now_ms: int) -> int:
    """Unix ms of '3 days ago', '2 weeks ago', '1 month ago' (30 days), '1 year ago' (365 days) or an ISO date or time."""
    m = re.fullmatch(r"\s*(\d+)\s+(day|week|month|year)s?\s+ago\s*", text, re.I)
    if m:
        return now_ms - int(m[1]) * {"day": 1, "week": 7, "month": 30, "year": 365}[m[2].lower()] * DAY
    from datetime import UTC, datetime

    d = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    return int((d if d.tzinfo else d.replace(tzinfo=UTC)).timestamp() * 1000)


def clamp(value: int | None, low: int, high: int, default: int) -> int:
    return default if value is None else max(low, min(high, value))


def as_of(nodes: DataFrame, t: int, limit: int | None = None) -> DataFrame:
    """Nodes valid at t, most important first (ties: id), with total, their number before the limit."""
    live = nodes.where(valid_at(t) & F.col("archived_at").isNull())
    shown = live if limit is None else live.orderBy(F.desc("importance"), "id").limit(limit)
    # one row, the total, joins every row shown
    return shown.join(F.broadcast(live.agg(F.count(F.lit(1)).alias("total"))))


def superseded_by(nodes: DataFrame, t: int) -> DataFrame:
    """Nodes whose validity ended at or before t."""
    return nodes.where(F.col("t_valid_until") <= t)


def compare_states(nodes: DataFrame, since: int, until: int) -> DataFrame:
    """(id, type, change) with change added, invalidated or archived within [since, until]; one scan, a node may have several."""
    inside = lambda c: F.col(c).between(since, until)
    changes = F.array_compact(
        F.array(F.when(inside("t_created"), F.lit("added")), F.when(inside("t_valid_until"), F.lit("invalidated")), F.when(inside("archived_at"), F.lit("archived")))
    )
    return nodes.select("id", "type", F.explode(changes).alias("change"))


def history_by_day(nodes: DataFrame, since: int, until: int) -> DataFrame:
    """(day, type, n): nodes created within [since, until] per UTC day and type."""
    day = F.date_format(F.timestamp_millis("created_at"), "yyyy-MM-dd")
    return nodes.where(F.col("created_at").between(since, until)).groupBy(day.alias("day"), "type").agg(F.count(F.lit(1)).alias("n"))


def history_list(nodes: DataFrame, since: int, until: int, k: int = 100) -> DataFrame:
    """The k newest nodes created within [since, until], newest first (ties: id)."""
    return nodes.where(F.col("created_at").between(since, until)).orderBy(F.desc("created_at"), "id").limit(k)


def as_of_edges(edges: DataFrame, t: int, k: int) -> DataFrame:
    """The k heaviest edges valid at t (ties: id) with total, their number before the limit."""
    live = edges.where(valid_at(t))
    shown = live.orderBy(F.desc("weight"), "id").limit(k)
    return shown.join(F.broadcast(live.agg(F.count(F.lit(1)).alias("total"))))  # one row


def totals(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n): rows of each table, as one union of counts."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def digest(nodes: DataFrame, until: int, period: str) -> DataFrame:
    """(position, type, n, names): what became known in the period before `until`, in the fixed order of types, with the five most important names."""
    days = {"daily": 1, "weekly": 7, "monthly": 30}[period]
    order = ["Decision", "Convention", "Bug", "Solution", "Concept"]
    position = reduce(lambda acc, x: F.when(F.col("type") == x[1], x[0]).otherwise(acc), enumerate(order), F.lit(len(order)))
    w = Window.partitionBy("type").orderBy(F.desc("importance"), "id")
    rows = nodes.where(is_active() & F.col("created_at").between(until - days * DAY, until)).select("type", "name", "importance", "id")
    # counted on the way; only five of a type are brought together
    counts = rows.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda x: x["name"])
    first = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= 5).groupBy(F.col("type").alias("t")).agg(F.concat_ws(" | ", names).alias("names"))
    return counts.join(first, F.col("type").eqNullSafe(F.col("t"))).select("type", "n", "names").withColumn("position", position)


def prune_archived(nodes: DataFrame, edges: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without archived, not superseded nodes, and without what hangs on them."""
    gone = nodes.where(F.col("archived_at").isNotNull() & F.col("t_valid_until").isNull()).select("id")
    kept = nodes.join(gone, "id", "left_anti")
    e = edges.join(gone.withColumnRenamed("id", "from_id"), "from_id", "left_anti").join(gone.withColumnRenamed("id", "to_id"), "to_id", "left_anti")
    return kept, e, members.join(gone.withColumnRenamed("id", "entity_id"), "entity_id", "left_anti")


def compactable(nodes: DataFrame, degrees: DataFrame, now: int) -> DataFrame:
    """(id, reason) of versions that may be dropped: archived over 90 days ago, or archived unimportant events without edges after 30."""
    n = nodes.join(degrees, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    reason = F.when(F.col("archived_at") < now - 90 * DAY, "archived").when(
        F.col("archived_at").isNotNull() & F.col("type").like("%Event") & (F.col("importance") < 0.05) & (F.col("degree") == 0) & (F.col("archived_at") < now - 30 * DAY), "event"
    )
    return n.select("id", reason.alias("reason")).where("reason is not null")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): active edges at a node in either direction; a self-loop counts twice, as the stored counter does."""
    ends = edges.where(edge_is_active()).select(F.explode(F.array("from_id", "to_id")).alias("id")).where("id is not null")
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def resolve_conflict(nodes: DataFrame, group: str, keep: str, now: int) -> DataFrame:
    """The nodes after a conflict group was settled: all but the kept one end now, and the group is cleared."""
    inside = F.col("conflict_group_id").eqNullSafe(F.lit(group))
    ends = inside & (F.col("id") != keep)
    return (
        nodes.withColumn("t_valid_until", F.when(ends, F.lit(now)).otherwise(F.col("t_valid_until")))
        .withColumn("t_expired", F.when(ends, F.lit(now)).otherwise(F.col("t_expired")))
        .withColumn("conflict_group_id", F.when(inside, F.lit(None).cast("string")).otherwise(F.col("conflict_group_id")))
    )


def nearest_before(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, value: str) -> DataFrame:
    """As-of join: for each row of left the `value` of right's last row with the same key and right_ts <= left_ts.

    Both sides are one union, sorted once per key; the last value seen is carried forward. No range join takes place. If right has a
    time twice, its largest value counts. Left rows without a match get null.
    """
    r = right.groupBy(F.col(key).alias("_k"), F.col(right_ts).alias("_t")).agg(F.max(value).alias("_v")).select("_k", "_t", "_v", F.lit(0).alias("_side"), F.lit(None).cast(left_struct(left)).alias("_row"))
    lft = left.select(F.col(key).alias("_k"), F.col(left_ts).alias("_t"), F.lit(None).cast(dict(right.dtypes)[value]).alias("_v"), F.lit(1).alias("_side"), F.struct(*left.columns).cast(left_struct(left)).alias("_row"))
    w = Window.partitionBy("_k").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return r.unionByName(lft).withColumn("_last", F.last("_v", ignorenulls=True).over(w)).where("_side = 1").select("_row.*", F.col("_last").alias(f"nearest_{value}"))


def left_struct(df: DataFrame) -> str:
    return "struct<" + ",".join(f"`{n}`:{t}" for n, t in df.dtypes) + ">"
