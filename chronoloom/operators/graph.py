"""Graph analytics as iterated joins. Edges are (a, b[, w]) pairs; `symmetric` ones have both directions.

Loops cut their lineage by written tables and stop when nothing changes; nothing but counts comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.bitemporal import edge_is_active, is_active
from chronoloom.operators.components import connected_components
from chronoloom.operators.relational import top_k
from chronoloom.session import discard, materialize


#: Gain of modularity in a round under which communities count as settled.
SETTLED = 1e-3
#: Seeds that shortest_paths() answers for in one call.
MAX_SEEDS = 1000


def reach(pairs: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """(seed, id, depth): every node within `depth` hops of each seed (id), without a depth every node in reach, at its smallest distance,
    seeds included at 0."""
    pairs = pairs.select("a", "b").where("a is not null and b is not null").distinct()
    seen = materialize(seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("depth")).where("id is not null").distinct(), "reach")
    step = 0
    while depth is None or step < depth:
        step += 1
        edge = seen.where(F.col("depth") == step - 1).select("seed", F.col("id").alias("a"))
        ahead = edge.join(pairs, "a").select("seed", F.col("b").alias("id")).distinct().join(seen.select("seed", "id"), ["seed", "id"], "left_anti")
        grown = materialize(seen.unionByName(ahead.withColumn("depth", F.lit(step))), "reach")
        more = grown.where(F.col("depth") == step).limit(1).count()
        discard(seen)
        seen = grown
        if not more:
            break
    return seen


def expand(sym: DataFrame, seeds: DataFrame, depth: int = 2, most_nodes: int = 50, most_edges: int = 200) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around each seed, nearest first (ties: id): at most 50 nodes and, among these, 200 edges. The caps are the feature."""
    near = top_k(reach(sym, seeds, depth), ["seed"], [F.asc("depth"), F.asc("id")], most_nodes).select("seed", "id", "depth")
    e = sym.where("a <= b").select(F.col("id").alias("edge"), "a", "b").dropDuplicates(["edge"])
    both = e.join(near.select("seed", F.col("id").alias("a"), F.col("depth").alias("da")), "a").join(near.select("seed", F.col("id").alias("b"), F.col("depth").alias("db")), ["seed", "b"])
    return near, top_k(both.withColumn("d", F.greatest("da", "db")), ["seed"], [F.asc("d"), F.asc("edge")], most_edges).select("seed", "edge", "a", "b")


def impact_layers(sym: DataFrame, seeds: DataFrame, depth: int = 3, confidence: float = 0.5) -> DataFrame:
    """(seed, id, depth, label): what a change of the seed may break, over edges of enough confidence."""
    r = reach(sym.where(F.col("confidence") >= confidence), seeds, depth).where("depth > 0")
    return r.withColumn("label", F.when(F.col("depth") == 1, "WILL BREAK").when(F.col("depth") == 2, "LIKELY AFFECTED").otherwise("MAY NEED TESTING"))


def pagerank(edges: DataFrame, nodes: DataFrame, seeds: DataFrame | None = None, damping: float = 0.85, rounds: int = 30, tolerance: float = 1e-6, dangling: str = "spread") -> DataFrame:
    """(id, score). edges (a, b), parallel ones count; nodes (id). seeds: nodes that get nearly all of the teleport.

    dangling: 'spread' gives the mass of nodes without way out to all nodes alike, 'drop' loses it. Starts at the teleport vector and
    stops when the scores change by less than the tolerance in sum. One join and one aggregation per round.
    """
    nodes = nodes.select("id").distinct()
    n = nodes.count()
    if not n:
        return nodes.withColumn("score", F.lit(0.0))
    t: Column = F.lit(1.0 / n)
    if seeds is not None:
        k = seeds.select("id").distinct().join(nodes, "id", "left_semi").count()
        if k:
            nodes = nodes.join(seeds.select("id", F.lit(True).alias("s")).distinct(), "id", "left")
            t = F.when(F.col("s"), 0.99 / k).otherwise(0.01 / n)
    e = edges.select("a", "b").join(nodes.select(F.col("id").alias("a")), "a", "left_semi").join(nodes.select(F.col("id").alias("b")), "b", "left_semi")
    out = e.groupBy("a").agg(F.count(F.lit(1)).alias("out"))
    links = materialize(e.join(out, "a").select("a", "b", (1.0 / F.col("out")).alias("share")), "links")
    state = materialize(nodes.select("id", t.alias("t")).join(out.withColumnRenamed("a", "id"), "id", "left").withColumn("score", F.col("t")), "rank")
    ends = F.coalesce(F.sum(F.when(F.col("out").isNull(), F.col("score"))), F.lit(0.0))
    lost = state.agg(ends).first()[0]
    for _ in range(rounds):
        lost = lost if dangling == "spread" else 0.0
        into = links.join(state.select(F.col("id").alias("a"), "score"), "a").groupBy(F.col("b").alias("id")).agg(F.sum(F.col("score") * F.col("share")).alias("into"))
        fresh = state.join(into, "id", "left").select("id", "t", "out", F.col("score").alias("was"), ((1 - damping) * F.col("t") + damping * (F.coalesce("into", F.lit(0.0)) + lost / n)).alias("score"))
        after = materialize(fresh, "rank")
        delta, lost = after.agg(F.sum(F.abs(F.col("score") - F.col("was"))), ends).first()
        discard(state)
        state = after.drop("was")
        state._chronoloom_path = after._chronoloom_path
        if delta < tolerance:
            break
    discard(links)
    return state.select("id", "score")


def shortest_paths(pairs: DataFrame, seeds: DataFrame, nodes: DataFrame) -> DataFrame:
    """(seed, id, distance) along directed pairs of weight 1; a node out of reach has a null distance. The result has a row per seed and
    node, so more than MAX_SEEDS seeds are an error: reach() gives the nodes in reach for any number of seeds."""
    asked = [x[0] for x in seeds.select("id").where("id is not null").distinct().limit(MAX_SEEDS + 1).collect()]
    if len(asked) > MAX_SEEDS:
        raise ValueError(f"more than {MAX_SEEDS} seeds")
    r = reach(pairs, seeds).withColumnRenamed("depth", "distance")
    every = nodes.select("id").distinct().withColumn("seed", F.explode(F.array(*[F.lit(x) for x in asked]).cast("array<string>")))
    return every.join(r, ["seed", "id"], "left").select("seed", "id", "distance")


def betweenness(pairs: DataFrame, sources: DataFrame, undirected: bool = True) -> DataFrame:
    """(id, score): Brandes' dependencies summed over the given sources, as joins by level: forward for the number of shortest paths,
    backward for the dependencies. With undirected pairs (both directions listed) scores are halved."""
    pairs = materialize(pairs.select("a", "b").where("a is not null and b is not null and a <> b").distinct(), "pairs")
    seen = materialize(sources.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(0).alias("d"), F.lit(1.0).alias("paths")).distinct(), "levels")
    depth = 0
    while True:
        ahead = seen.where(F.col("d") == depth).select("s", F.col("v").alias("a"), "paths").join(pairs, "a").groupBy("s", F.col("b").alias("v")).agg(F.sum("paths").alias("paths"))
        fresh = ahead.join(seen.select("s", "v"), ["s", "v"], "left_anti").withColumn("d", F.lit(depth + 1))
        seen = materialize(seen.unionByName(fresh.select("s", "v", "d", "paths")), "levels")
        if not seen.where(F.col("d") == depth + 1).limit(1).count():
            break
        depth += 1
    gained = materialize(seen.where(F.col("d") == depth).select("s", "v", F.lit(0.0).alias("g")), "gained")
    parts = [gained]
    for level in range(depth - 1, 0, -1):
        below = seen.where(F.col("d") == level + 1).join(gained, ["s", "v"]).select("s", F.col("v").alias("b"), F.col("paths").alias("pw"), "g")
        own = seen.where(F.col("d") == level).select("s", "v", "paths")
        up = own.join(pairs.withColumnRenamed("a", "v"), "v").join(below, ["s", "b"], "left").groupBy("s", "v").agg(F.coalesce(F.sum(F.col("paths") / F.col("pw") * (1 + F.col("g"))), F.lit(0.0)).alias("g"))
        gained = materialize(up, "gained")
        parts.append(gained)
    total = parts[0]
    for p in parts[1:]:
        total = total.unionByName(p)
    scores = total.where("s <> v").groupBy(F.col("v").alias("id")).agg(F.sum("g").alias("score"))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return ids.join(scores, "id", "left").select("id", (F.coalesce("score", F.lit(0.0)) / (2 if undirected else 1)).alias("score"))


#: How much a kind of edge ties communities together; any other kind counts 0.3.
TYPE_WEIGHTS = {"calls": 0.5, "imports": 0.5, "inherits_from": 0.5, "contains": 0.5, "depends_on": 0.5, "co_occurrence": 0.3, "cochange": 0.2, "git-cochange": 0.2}


def community_graph(edges: DataFrame) -> DataFrame:
    """(a, b, w), a < b: undirected weight between nodes, the sum of weight times kind weight over active edges, self-loops left out."""
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in TYPE_WEIGHTS.items() for x in kv])[F.col("type")], F.lit(0.3))
    e = edges.where(edge_is_active()).where("from_id is not null and to_id is not null and from_id <> to_id")
    return e.groupBy(F.least("from_id", "to_id").alias("a"), F.greatest("from_id", "to_id").alias("b")).agg(F.sum(F.coalesce("weight", F.lit(1.0)) * kind).alias("w"))


def modularity(graph: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(modularity): one row, for graph (a, b, w) with a < b and labels (id, community)."""
    la, lb = labels.select(F.col("id").alias("a"), F.col("community").alias("ca")), labels.select(F.col("id").alias("b"), F.col("community").alias("cb"))
    e = graph.join(la, "a").join(lb, "b")
    ends = e.select(F.explode(F.array("ca", "cb")).alias("c"), "w").groupBy("c").agg(F.sum("w").alias("k"))
    inside = e.agg(F.sum("w").alias("m"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("within"))
    return ends.agg(F.sum(F.col("k") * F.col("k")).alias("kk")).join(inside).select((F.col("within") / F.col("m") - resolution * F.col("kk") / (4 * F.col("m") * F.col("m"))).alias("modularity"))


def _local_moves(graph: DataFrame, resolution: float, rounds: int) -> DataFrame:
    """(id, community) after synchronous local moves; a round lets one half of the nodes move, so that neighbours don't swap."""
    both = materialize(graph.select("a", "b", "w").unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")), "both")
    k = both.groupBy("a").agg(F.sum("w").alias("k"))
    two_m = both.agg(F.sum("w")).first()[0] or 1.0
    labels = materialize(k.select(F.col("a").alias("id"), "k", F.col("a").alias("c")), "labels")
    quiet, reached = 0, -1.0
    for i in range(rounds):
        tot = labels.groupBy("c").agg(F.sum("k").alias("tot"))
        near = both.where("a <> b").join(labels.select(F.col("id").alias("b"), "c"), "b").groupBy(F.col("a").alias("id"), "c").agg(F.sum("w").alias("inside"))
        own = labels.select("id", "k", F.col("c").alias("mine"))
        stay = labels.select("id", "c").withColumn("inside", F.lit(0.0))
        rows = near.unionByName(stay).groupBy("id", "c").agg(F.sum("inside").alias("inside")).join(own, "id").join(tot, "c")
        without = F.when(F.col("c") == F.col("mine"), F.col("tot") - F.col("k")).otherwise(F.col("tot"))
        gain = F.round(F.col("inside") - resolution * F.col("k") * without / two_m, 9)
        best = rows.withColumn("gain", gain).groupBy("id").agg(F.max("k").alias("k"), F.max("mine").alias("mine"), F.max(F.when(F.col("c") == F.col("mine"), F.col("inside") - resolution * F.col("k") * F.col("tot") / two_m)).alias("q"), F.max_by("c", F.struct("gain", F.col("c") == F.col("mine"), "c")).alias("to"))
        turn = F.pmod(F.xxhash64("id"), F.lit(2)) == i % 2
        after = materialize(best.select("id", "k", F.when(turn, F.col("to")).otherwise(F.col("mine")).alias("c"), (F.col("q") / two_m).alias("q"), (turn & (F.col("to") != F.col("mine"))).alias("moved")), "labels")
        moved, q = after.agg(F.count_if("moved"), F.sum("q")).first()
        quiet = quiet + 1 if not moved or q < reached + SETTLED else 0
        reached = max(reached, q or 0.0)
        discard(labels)
        labels = after.drop("moved", "q")
        labels._chronoloom_path = after._chronoloom_path
        if quiet == 2:
            break
    # a community that fell apart is several: each connected part is one, under its smallest node
    la, lb = labels.select(F.col("id").alias("a"), F.col("c").alias("ca")), labels.select(F.col("id").alias("b"), F.col("c").alias("cb"))
    inside = graph.join(la, "a").join(lb, "b").where("ca = cb").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    parts = connected_components(inside)
    return labels.join(parts, "id", "left").select("id", F.coalesce("component", "id").alias("community"))


def communities(graph: DataFrame, resolutions: tuple[float, ...] = (2.0, 1.0, 0.5), rounds: int = 30) -> DataFrame:
    """(level, id, community): local moves on the nodes for as long as modularity grows by SETTLED within two rounds (and for `rounds` rounds
    at most: moves made at the same time can undo each other for ever), then on the graph of the communities
    found, once per resolution. A community is connected and named by its smallest node; level 0 is the finest."""
    level_graph, names = materialize(graph.select("a", "b", "w"), "level"), None
    out = None
    for level, r in enumerate(resolutions):
        moved = materialize(_local_moves(level_graph, r, rounds), "moved")
        names = moved if names is None else materialize(names.withColumnRenamed("community", "u").join(moved.select(F.col("id").alias("u"), "community"), "u", "left").select("id", F.coalesce("community", "u").alias("community")), "names")
        rows = names.withColumn("level", F.lit(level)).select("level", "id", "community")
        out = rows if out is None else out.unionByName(rows)
        la, lb = moved.select(F.col("id").alias("a"), F.col("community").alias("ca")), moved.select(F.col("id").alias("b"), F.col("community").alias("cb"))
        merged = level_graph.join(la, "a").join(lb, "b").groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("w").alias("w"))
        level_graph = materialize(merged, "level")
    return out


def cohesion(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(community_id, internal, incident, cohesion): of the active edges that touch a community, the share within it."""
    m = members.select("community_id", "entity_id").distinct()
    e = edges.where(edge_is_active()).select(F.col("id").alias("edge"), "from_id", "to_id")
    ends = e.select("edge", F.explode(F.array_distinct(F.array("from_id", "to_id"))).alias("entity_id"), F.when(F.col("from_id") == F.col("to_id"), 1).otherwise(2).alias("need"))
    per = ends.join(m, "entity_id").groupBy("community_id", "edge").agg((F.count(F.lit(1)) == F.max("need")).alias("inside"))
    return per.groupBy("community_id").agg(F.count_if("inside").alias("internal"), F.count(F.lit(1)).alias("incident"), (F.count_if("inside") / F.count(F.lit(1))).alias("cohesion"))


def community_summaries(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(community_id, summary, summary_hash, member_count): five leading members as name: summary, and a hash that tells whether members
    changed: of their number and the sum of their ids' hashes, so that no list of all members is made."""
    rows = members.select("community_id", "entity_id").distinct().join(nodes.where(is_active()).select(F.col("id").alias("entity_id"), "name", "summary", "importance"), "entity_id")
    lead = F.array_sort(F.collect_list(F.struct("r", F.concat_ws(": ", "name", "summary").alias("t"))))
    first = top_k(rows, ["community_id"], [F.desc("importance"), F.asc("entity_id")], 5).groupBy("community_id").agg(F.array_join(F.transform(lead, lambda x: x["t"]), "; ").alias("summary"))
    ids = F.sum(F.conv(F.substring(F.md5("entity_id"), 1, 15), 16, 10).cast("decimal(38,0)")).cast("decimal(38,0)").cast("string")
    whole = rows.groupBy("community_id").agg(F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), ids), 256).alias("summary_hash"), F.count(F.lit(1)).alias("member_count"))
    return first.join(whole, "community_id").select("community_id", "summary", "summary_hash", "member_count")


def landmarks(nodes: DataFrame, sym: DataFrame, k: int = 25, hops: int = 5) -> DataFrame:
    """(landmark, id, distance) from the k most used active nodes (ties: id), up to `hops`."""
    marks = nodes.where(is_active()).orderBy(F.desc("access_count"), "id").limit(k).select("id")
    return reach(sym, marks, hops).select(F.col("seed").alias("landmark"), "id", F.col("depth").alias("distance"))


def estimated_distances(marks: DataFrame, ids: DataFrame, cap: int = 5) -> DataFrame:
    """(a, b, distance) of all pairs of a few chosen ids (more than MAX_SEEDS are an error): the shortest way over a landmark, at most `cap`,
    0 to itself."""
    if ids.select("id").distinct().limit(MAX_SEEDS + 1).count() > MAX_SEEDS:
        raise ValueError(f"more than {MAX_SEEDS} ids")
    own = marks.join(ids.select("id").distinct(), "id", "left_semi")
    via = own.select("landmark", F.col("id").alias("a"), F.col("distance").alias("x")).join(own.select("landmark", F.col("id").alias("b"), F.col("distance").alias("y")), "landmark")
    return via.groupBy("a", "b").agg(F.when(F.col("a") == F.col("b"), 0).otherwise(F.least(F.min(F.col("x") + F.col("y")), F.lit(cap))).alias("distance"))


def entry_point_scores(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, name, score) of active code nodes: exported, telling names, share of calls that come in, framework tags; within 0..1."""
    calls = edges.where(edge_is_active() & (F.col("type") == "calls"))
    count = lambda c, n: calls.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("id")).agg(F.count(F.lit(1)).alias(n))
    n = nodes.where(is_active() & (F.col("type") == "CodeEntity")).select("id", "name", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
    n = n.join(count("to_id", "i"), "id", "left").join(count("from_id", "o"), "id", "left").fillna(0, ["i", "o"])
    # Name patterns in order with their bonus, framework tags, weights.
    name = (
        F.when(F.col("name").rlike("(?i)^(main|index)$"), 0.55).when(F.col("name").rlike("^handle[A-Z]"), 0.4).when(F.col("name").rlike("^on[A-Z]"), 0.35).when(F.col("name").rlike("(?i)controller$"), 0.35).otherwise(0.0)
    )
    ratio = 0.2 * F.col("i") / F.when(F.col("i") + F.col("o") > 0, F.col("i") + F.col("o"))
    k = F.size(F.filter("tags", lambda t: F.lower(t).isin("route", "handler", "controller", "endpoint", "middleware")))
    score = F.when(F.array_contains("tags", "isExported"), 0.35).otherwise(0.0) + name + F.when(ratio > 0.01, ratio).otherwise(0.0) + F.when(k > 0, F.least(F.lit(0.55), 0.35 + 0.15 * (k - 1))).otherwise(0.0)
    return n.select("id", "name", F.least(F.lit(1.0), score).alias("score"))


def trace_processes(calls: DataFrame, starts: DataFrame, depth: int = 10, branches: int = 4) -> DataFrame:
    """(path): call chains from the starts (id), no node twice, at most `branches` callees followed per step (ties: id), without chains
    whose nodes are all in a longer one. calls: (a, b, confidence)."""
    best = calls.where("a <> b and confidence >= 0.5").groupBy("a", "b").agg(F.max("confidence").alias("confidence"))
    step = materialize(top_k(best, ["a"], [F.desc("confidence"), F.asc("b")], branches).select("a", "b"), "steps")
    open_ = materialize(starts.select(F.array("id").alias("path")).distinct(), "paths")
    done = None
    for _ in range(depth - 1):
        grown = open_.withColumn("a", F.element_at("path", -1)).join(step, "a").where(~F.array_contains("path", F.col("b")))
        longer = materialize(grown.select("path", F.concat("path", F.array("b")).alias("longer")), "paths")
        ended = open_.join(longer.select("path").distinct(), "path", "left_anti")
        done = ended if done is None else done.unionByName(ended)
        open_ = longer.select(F.col("longer").alias("path"))
        if not open_.limit(1).count():
            break
    chains = materialize(done.unionByName(open_).where(F.size("path") > 1).distinct(), "chains")
    # a chain can only be within one that has its first node
    nodes = chains.select(F.col("path").alias("other"), F.explode("path").alias("x"))
    hits = chains.withColumn("x", F.col("path")[0]).join(nodes, "x").where(F.size("other") > F.size("path"))
    inside = hits.where(F.size(F.array_except("path", "other")) == 0).select("path").distinct()
    return chains.join(inside, "path", "left_anti")


def dirty_nodes(changed: DataFrame, nodes: DataFrame, sym: DataFrame, degree: DataFrame, hops: int = 2, firewall: int = 50) -> DataFrame:
    """(id, state, depth): nodes that depend on changed files are dirty, and so are their neighbours up to `hops`; a neighbour with more
    than `firewall` edges is only maybe_dirty and passes nothing on. changed: (file)."""
    first = nodes.where(is_active()).select("id", F.explode("file_paths").alias("file")).join(changed.distinct(), "file", "left_semi").select("id").distinct()
    state = materialize(first.select("id", F.lit("dirty").alias("state"), F.lit(0).alias("depth")), "dirty")
    for d in range(1, hops + 1):
        ahead = state.where((F.col("depth") == d - 1) & (F.col("state") == "dirty")).select(F.col("id").alias("a")).join(sym.select("a", "b").distinct(), "a").select(F.col("b").alias("id")).distinct()
        ahead = ahead.join(state.select("id"), "id", "left_anti").join(degree, "id", "left")
        kind = F.when(F.col("degree") > firewall, "maybe_dirty").otherwise("dirty")
        state = materialize(state.unionByName(ahead.select("id", kind.alias("state"), F.lit(d).alias("depth"))), "dirty")
    return state


def tree_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, change, kind, was) between two lists of symbols (name, kind, parent): insert, remove, move (parent differs), update (kind
    differs). The i-th symbol of a name is compared with the i-th of the other side."""
    w = Window.partitionBy("name").orderBy("kind", "parent")
    number = lambda d, p: d.withColumn("i", F.row_number().over(w)).select("name", "i", F.col("kind").alias(f"{p}_kind"), F.col("parent").alias(f"{p}_parent"), F.lit(True).alias(p))
    both = number(old, "o").join(number(new, "n"), ["name", "i"], "full")
    change = (
        F.when(F.col("o").isNull(), "insert").when(F.col("n").isNull(), "remove").when(~F.col("o_kind").eqNullSafe(F.col("n_kind")), "update").when(~F.col("o_parent").eqNullSafe(F.col("n_parent")), "move")
    )
    return both.select("name", change.alias("change"), F.coalesce("n_kind", "o_kind").alias("kind"), F.col("o_kind").alias("was")).where("change is not null")
