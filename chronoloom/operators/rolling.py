"""Rolling totals over trailing periods, answered from segment trees.

A tree stands for one entity and time shard of 2**HEIGHT days. Node (level, idx) holds the sums and counts of the days
[idx * 2**level, (idx + 1) * 2**level), so a node's shard is idx >> (HEIGHT - level). A trailing window is the union of
O(log window) nodes; a late correction touches its day's HEIGHT + 1 ancestors and nothing else. StoredTree keeps the nodes as
a table in folders by time shard: a correction reads and rewrites the folders of its days only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.session import discard, drop_at_exit, materialize, shared_dir

#: A shard of a tree spans 2**HEIGHT days.
HEIGHT = 6
#: Sums are exact decimals: order of addition cannot change them, and corrections can be taken back.
MONEY = "decimal(38,9)"
MEASURES = ("cost_sum", "cost_n", "tokens_sum", "tokens_n", "calls")


def tidy_name(c: Column) -> Column:
    """One spelling of a name: trimmed, lower case; a missing or blank one is (none)."""
    return F.coalesce(F.when(F.trim(c) != "", F.lower(F.trim(c))), F.lit("(none)"))


def tidy_millis(c: Column) -> Column:
    """Unix milliseconds; values below 1e11 (before March 1973 as milliseconds) were written in seconds."""
    return F.when(F.abs(c) < 100_000_000_000, c * 1000).otherwise(c)


def daily_costs(entries: DataFrame) -> DataFrame:
    """Leaves: entity (provider), day (days since 1970, UTC) and the measures. An entry_id counts once: of its copies, the one
    received last (ties: by value). Entries without id count each; those without timestamp belong to no day and are left out.
    """
    e = entries.select(
        "entry_id",
        tidy_name(F.col("provider")).alias("entity"),
        F.floor(tidy_millis(F.col("timestamp").cast("long")) / 86_400_000).cast("long").alias("day"),
        F.col("estimated_cost").cast(MONEY).alias("cost"),
        F.col("input_tokens").cast("long").alias("tokens"),
        F.col("received_at").alias("received_at"),
    ).where(F.col("day").isNotNull())
    body = F.struct("received_at", "entity", "day", "cost", "tokens")
    keyed = e.where("entry_id is not null").groupBy("entry_id").agg(F.max(body).alias("b")).select("b.*")
    e = keyed.unionByName(e.where("entry_id is null").drop("entry_id"))
    return e.groupBy("entity", "day").agg(
        F.coalesce(F.sum("cost"), F.lit(0)).cast(MONEY).alias("cost_sum"),
        F.count("cost").alias("cost_n"),
        F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens_sum"),
        F.count("tokens").alias("tokens_n"),
        F.count(F.lit(1)).alias("calls"),
    )


def _sum_measures() -> list[Column]:
    return [F.sum(m).cast(MONEY if m == "cost_sum" else "long").alias(m) for m in MEASURES]


def ancestors(leaves: DataFrame) -> DataFrame:
    """Each leaf once per level: the rows of which the tree nodes are sums."""
    return leaves.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(HEIGHT)))).withColumn(
        "idx", F.expr("shiftright(day, level)")
    )


def build_tree(leaves: DataFrame) -> DataFrame:
    """Tree nodes (entity, level, idx, measures) of all days that have entries."""
    return ancestors(leaves).groupBy("entity", "level", "idx").agg(*_sum_measures())


def correct_tree(tree: DataFrame, deltas: DataFrame, summed: bool = False) -> DataFrame:
    """The tree after late corrections. deltas: leaves whose measures are to be added (negative to take back), or, if summed, the nodes above
    them.

    Only ancestors of corrected days are touched: all other nodes pass through a left join on the few changed keys.
    """
    change = (deltas if summed else build_tree(deltas)).select("entity", "level", "idx", *[F.col(m).alias(f"d_{m}") for m in MEASURES])
    kept = tree.join(change.select("entity", "level", "idx"), ["entity", "level", "idx"], "left_anti")
    touched = change.join(tree, ["entity", "level", "idx"], "left").select(
        "entity",
        "level",
        "idx",
        *[(F.coalesce(F.col(m), F.lit(0)) + F.col(f"d_{m}")).cast(MONEY if m == "cost_sum" else "long").alias(m) for m in MEASURES],
    )
    return kept.unionByName(touched)


def window_cover(first: str, last: str) -> Column:
    """The tree nodes (level, idx) that make up the days first..last, aligned as in a segment tree: at every level a left
    odd end and a right even end. The expression is a fold over the levels and stays in the JVM.
    """
    return F.expr(
        f"""aggregate(sequence(0, {HEIGHT}),
            named_struct('lo', {first}, 'hi', {last}, 'out', cast(array() as array<struct<level:int,idx:bigint>>)),
            (s, l) -> if(s.lo > s.hi, s, if(l = {HEIGHT},
              named_struct('lo', 1L, 'hi', 0L, 'out', concat(s.out, transform(sequence(s.lo, s.hi), i -> named_struct('level', l, 'idx', i)))),
              named_struct(
                'lo', shiftright(s.lo + 1, 1),
                'hi', shiftright(s.hi - 1, 1),
                'out', concat(s.out,
                  if(s.lo % 2 != 0, array(named_struct('level', l, 'idx', s.lo)), cast(array() as array<struct<level:int,idx:bigint>>)),
                  if(s.hi % 2 = 0 and s.hi >= s.lo, array(named_struct('level', l, 'idx', s.hi)), cast(array() as array<struct<level:int,idx:bigint>>)))))),
            s -> s.out)"""
    )


def corrections(entries: DataFrame, late: DataFrame) -> DataFrame:
    """Leaves to add to the tree of `entries` when `late` entries come in: a late copy of a known entry takes the place of the one
    before it, if it was received later; so the old measures of the touched ids are taken back and the new ones added."""
    old = entries.join(late.select("entry_id").where("entry_id is not null").distinct(), "entry_id", "left_semi").select(*late.columns)
    minus = daily_costs(old).select("entity", "day", *[(-F.col(m)).alias(m) for m in MEASURES])
    return daily_costs(old.unionByName(late)).unionByName(minus).groupBy("entity", "day").agg(*_sum_measures()).where(" or ".join(f"{m} <> 0" for m in MEASURES))


class StoredTree:
    """A tree as a table in the shared folder, a folder per time shard."""

    def __init__(self, leaves: DataFrame) -> None:
        self.spark = leaves.sparkSession
        self.path = f"{shared_dir(self.spark)}/tree-{uuid.uuid4().hex}"
        rows = self._sharded(build_tree(leaves))
        self.schema = rows.schema
        rows.write.partitionBy("shard").parquet(self.path)
        drop_at_exit(self.spark, self.path)

    @staticmethod
    def _sharded(tree: DataFrame) -> DataFrame:
        return tree.withColumn("shard", F.expr(f"shiftright(idx, {HEIGHT} - level)"))

    def nodes(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def correct(self, deltas: DataFrame) -> list[int]:
        """Add deltas (leaves) to the ancestors of their days. Returns the shards that were rewritten: days / 2**HEIGHT at most."""
        change = materialize(self._sharded(build_tree(deltas)), "change")
        shards = sorted(r["shard"] for r in change.select("shard").distinct().collect())
        if shards:
            touched = self.nodes().where(F.col("shard").isin(shards)).drop("shard")
            after = materialize(self._sharded(correct_tree(touched, change.drop("shard"), summed=True)), "corrected")
            after.select(*[f.name for f in self.schema.fields]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(self.path)
            discard(after)
        discard(change)
        return shards


def window_parts(tree: DataFrame, windows: tuple[int, ...]) -> DataFrame:
    """(entity, day, window_days, measures of one tree node) for every node that covers a part of the window's days.

    Every day of an entity from its first to its last is there, also without entries (measures null). Before an entity's
    first day nothing is counted. A day whose entries were all taken back is one without entries.
    """
    span = tree.where("level = 0 and calls > 0").withColumnRenamed("idx", "day").groupBy("entity").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    days = (
        span.withColumn("day", F.explode(F.sequence("lo", "hi")))
        .withColumn("window_days", F.explode(F.array(*[F.lit(w) for w in windows])))
        .withColumn("first", F.greatest(F.col("lo"), F.col("day") - F.col("window_days") + 1))
    )
    parts = days.select("entity", "day", "window_days", F.inline(window_cover("first", "day")))
    return parts.join(tree, ["entity", "level", "idx"], "left")


def rolling_totals(leaves: DataFrame, windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """(entity, day, window_days, measures) for every entity, every day from its first to its last, and each window."""
    filled = [F.coalesce(F.sum(m), F.lit(0)).cast(MONEY if m == "cost_sum" else "long").alias(m) for m in MEASURES]
    return window_parts(build_tree(leaves), windows).groupBy("entity", "day", "window_days").agg(*filled)


def rolling_costs(entries: DataFrame, windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """cost_windows() of the tree of cost entries. Timestamps below 1e11 are seconds. Empty input gives an empty result."""
    return cost_windows(build_tree(daily_costs(entries)), windows)


def cost_windows(tree: DataFrame, windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """One row per provider and UTC day from its first to its last, with sums and averages over each trailing window.

    cost_sum_w and tokens_sum_w count a missing value as nothing. *_avg_w is the mean over the calls in the window that have
    the value (null if none has). *_per_day_w divides the sum by all w days. Provider names are compared trimmed and in
    lower case; a missing one is (none). An empty tree gives an empty result.
    """
    cols = []
    for w in windows:
        of = {m: F.coalesce(F.sum(F.when(F.col("window_days") == w, F.col(m))), F.lit(0)) for m in MEASURES}
        cost, n, tok, tn = of["cost_sum"].cast("double"), of["cost_n"], of["tokens_sum"].cast("long"), of["tokens_n"]
        cols += [
            cost.alias(f"cost_sum_{w}"),
            F.when(n > 0, cost / n).alias(f"cost_avg_{w}"),
            (cost / w).alias(f"cost_per_day_{w}"),
            tok.alias(f"tokens_sum_{w}"),
            F.when(tn > 0, tok / tn).alias(f"tokens_avg_{w}"),
            (tok / F.lit(w)).alias(f"tokens_per_day_{w}"),
            of["calls"].cast("long").alias(f"calls_{w}"),
        ]
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.col("day").cast("int"))
    rows = window_parts(tree, windows).groupBy("entity", "day").agg(*cols)
    return rows.select(F.col("entity").alias("provider"), day.alias("day"), *[c for c in rows.columns if c not in ("entity", "day")])
