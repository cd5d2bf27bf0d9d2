"""Filling fixed-capacity containers: minimum bin slack.

Items are spread over shards by hash. In a shard, every container takes the longest item left and then the combination of other
items that fills it best: a subset-sum table over the available lengths, kept as the bits of one integer, says which fills can
be reached, and the steps that reached the best are walked back. The chosen items are removed and the next container begins.
What a shard cannot fill well is packed once more, over fewer shards, until a budget's last shard, or until packing again no longer
halves what is left of a budget: then its containers stay as they are.
"""

from __future__ import annotations



import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.session import materialize

#: Items per shard. A shard is packed by one task; more items leave less space unused, but beyond some thousands hardly.
SHARD = 8_000
#: Budgets at most: every item is packed once for each.
BUDGETS = 1000
#: A container of a round that isn't the last counts as well filled from this share of its capacity; others are packed again.
WELL = 0.995


def best_fill(lengths: np.ndarray, counts: np.ndarray, space: int) -> list[tuple[int, int]]:
    """(length index, how many) of available items whose sum is as near to `space` as possible, never above.

    lengths are distinct and descending. Bit s of the table says that sum s can be reached; a length with count c is added in
    powers of two, so each costs log c shifts. The search ends at once when the space can be filled exactly.
    """
    mask, table = (1 << (space + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for i in np.searchsorted(-lengths, -space, "left") + np.arange(len(lengths) - np.searchsorted(-lengths, -space, "left")):
        size, left, part = int(lengths[i]), min(int(counts[i]), space // int(lengths[i])), 1
        while left > 0:
            take = min(part, left)
            grown = (table | (table << (size * take))) & mask
            if grown != table:
                steps.append((int(i), take, table))
                table = grown
            left -= take
            part *= 2
        if table >> space:
            break
    best = table.bit_length() - 1
    chosen: dict[int, int] = {}
    for i, take, before in reversed(steps):
        if not before >> best & 1:
            chosen[i] = chosen.get(i, 0) + take
            best -= int(lengths[i]) * take
    return list(chosen.items())


def pack(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Containers as lists of positions in sizes; every size is between 1 and capacity."""
    order = np.argsort(-sizes, kind="stable")
    lengths, starts, counts = np.unique(-sizes[order], return_index=True, return_counts=True)
    lengths, nxt, counts = -lengths, starts.copy(), counts.copy()
    out: list[list[int]] = []
    first = 0
    while True:
        while first < len(lengths) and not counts[first]:
            first += 1
        if first == len(lengths):
            return out
        members = [(first, 1)]
        counts[first] -= 1
        space = capacity - int(lengths[first])
        if space:
            live = np.flatnonzero(counts)
            if len(live):
                members += [(int(live[i]), k) for i, k in best_fill(lengths[live], counts[live], space)]
                for i, k in members[1:]:
                    counts[i] -= k
        bin_: list[int] = []
        for i, k in members:
            bin_ += order[nxt[i] : nxt[i] + k].tolist()
            nxt[i] += k
        out.append(bin_)


def split_items(items: DataFrame, budgets: DataFrame) -> DataFrame:
    """(budget_name, capacity, doc_id, piece, size): an item is one piece unless it alone exceeds the capacity; then it gives full
    pieces and one rest. Items without tokens have no size and are left out here."""
    sizes = budgets.select("budget_name", F.col("capacity_tokens").cast("long").alias("capacity")).where("capacity > 0").distinct().limit(BUDGETS + 1).collect()
    if len(sizes) > BUDGETS:
        raise ValueError(f"more than {BUDGETS} budgets")
    b = F.broadcast(budgets.sparkSession.createDataFrame([(r["budget_name"], r["capacity"]) for r in sizes], "budget_name string, capacity long"))
    n = F.ceil(F.col("n_tokens") / F.col("capacity")).cast("int")
    pieces = items.where("n_tokens > 0").join(b).withColumn("piece", F.explode(F.sequence(F.lit(0), n - 1)))
    return pieces.select("budget_name", "capacity", "doc_id", "piece", F.least("capacity", F.col("n_tokens") - F.col("piece") * F.col("capacity")).cast("long").alias("size"))


PACKED = "budget_name string, capacity long, doc_id long, piece int, size long, container string, fill long, done boolean"


def _round(items: DataFrame, shards: dict[str, int], number: int, last: frozenset[str]) -> DataFrame:
    n = F.lit(1)
    for name, k in shards.items():
        n = F.when(F.col("budget_name") == name, F.lit(k)).otherwise(n)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "piece"], ascending=[False, True, True], ignore_index=True)
        sizes, capacity = pdf["size"].to_numpy(np.int64), int(pdf["capacity"].iloc[0])
        container, fill = np.empty(len(pdf), np.int64), np.empty(len(pdf), np.int64)
        for c, members in enumerate(pack(sizes, capacity)):
            container[members] = c
            fill[members] = sizes[members].sum()
        keep = 0.0 if pdf["budget_name"].iloc[0] in last else WELL
        name = f"{number}-{int(pdf['shard'].iloc[0])}-"
        return pdf.drop(columns="shard").assign(container=[name + str(c) for c in container], fill=fill, done=fill >= keep * capacity)

    sharded = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", F.lit(number)), n))
    return sharded.groupBy("budget_name", "shard").applyInPandas(one, PACKED)


def pack_items(items: DataFrame, budgets: DataFrame) -> DataFrame:
    """(budget_name, container, capacity, fill, doc_id, piece, size): where every item (doc_id, n_tokens) goes, for each budget.

    An item is whole unless it exceeds the capacity. Items without tokens (null or empty texts) need no space and are in no
    container. Budgets without a positive capacity give nothing. Repeated rows of an item count once; of differing ones the largest.
    """
    once = items.groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))
    pieces = materialize(split_items(once, budgets), "pieces")
    # a piece as large as its container is one already
    full = pieces.where("size = capacity").select("budget_name", F.concat_ws("-", F.lit("full"), "doc_id", "piece").alias("container"), "capacity", F.col("size").alias("fill"), "doc_id", "piece", "size")
    out, left, number, before = [full], pieces.where("size < capacity"), 0, {}
    while True:
        n = {r["budget_name"]: r["n"] for r in left.groupBy("budget_name").agg(F.count(F.lit(1)).alias("n")).collect()}
        shards = {name: max(1, -(-k // SHARD)) for name, k in n.items()}
        last = frozenset(name for name, k in n.items() if shards[name] == 1 or 2 * k > before.get(name, 2 * k))
        placed = materialize(_round(left, shards, number, last), "placed")
        out.append(placed.where("done").select(*full.columns))
        if len(last) == len(n):
            break
        left, number, before = placed.where("not done").select("budget_name", "capacity", "doc_id", "piece", "size"), number + 1, n
    result = out[0]
    for df in out[1:]:
        result = result.unionByName(df)
    return result


def containers(placed: DataFrame) -> DataFrame:
    """One row per container with its members, fill and free space. Members are bounded by the capacity, a token each at least."""
    return placed.groupBy("budget_name", "container").agg(
        F.max("capacity").alias("capacity"), F.sum("size").alias("fill"), (F.max("capacity") - F.sum("size")).alias("slack"), F.count(F.lit(1)).alias("n_members"), F.array_sort(F.collect_list(F.struct("doc_id", "piece"))).alias("members")
    )


def fill_report(placed: DataFrame) -> DataFrame:
    """Containers, tokens and the share of space used, per budget."""
    per = placed.groupBy("budget_name", "container").agg(F.max("capacity").alias("capacity"), F.sum("size").alias("fill"), F.count(F.lit(1)).alias("n"))
    return per.groupBy("budget_name").agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("n").alias("n_pieces"), F.sum("fill").alias("n_tokens"), (F.sum("fill") / F.sum("capacity")).alias("used")
    )
