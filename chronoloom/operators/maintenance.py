"""The write path and upkeep of the graph: consolidation, staging, decay, freshness, sync and feedback, as whole-table transforms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.functions.text import array_jaccard, injection_score, word_jaccard, word_set
from chronoloom.operators.bitemporal import DAY, is_active
from chronoloom.operators.relational import top_k
from chronoloom.session import materialize

# Half-lives in days of importance and of confidence (with its multiplier), by type or tier.
IMPORTANCE_HALF_LIFE = {"Decision": 90.0, "Convention": 60.0, "Bug": 45.0, "Solution": 45.0}
CONFIDENCE_DECAY = {"Decision": (14.0, 1.0), "Convention": (21.0, 1.0), "Bug": (7.0, 1.5), "Solution": (7.0, 1.5), "Concept": (14.0, 1.0)}
USER_DECAY, EXTERNAL_DECAY = (30.0, 0.5), (7.0, 3.0)
#: Contents with one leading word that are compared in one block; more are cut into blocks, and each two blocks meet once.
BLOCK = 2000
#: Longs of the bitmap of a content's words.
BITMAP = 4
EXAMINATION = {0: 1.0, 1: 0.85, 2: 0.7, 3: 0.55, 4: 0.4, 5: 0.25}


def _lookup(c: Column, table: dict, default: float) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


# ---- consolidation and staging ------------------------------------------------------------------------------------


def consolidate(facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(fact_id, action, match_id, similarity): what becomes of each candidate fact (fact_id, name, type, content).

    No active node of that name and type: ADD. Else by word similarity with the one of the smallest id: above 0.8 NOOP, from 0.4
    UPDATE, below INVALIDATE (and add). Candidates are held against the graph, not against one another.
    """
    old = nodes.where(is_active()).groupBy("name", "type").agg(F.min(F.struct("id", "content")).alias("m"))
    j = facts.select("fact_id", "name", "type", "content").join(old, ["name", "type"], "left")
    s = word_jaccard(F.col("m.content"), F.col("content"))
    action = F.when(F.col("m").isNull(), "ADD").when(s > 0.8, "NOOP").when(s >= 0.4, "UPDATE").otherwise("INVALIDATE")
    return j.select("fact_id", action.alias("action"), F.col("m.id").alias("match_id"), F.when(F.col("m").isNotNull(), s).alias("similarity"))


def stage(facts: DataFrame) -> DataFrame:
    """External facts as staged rows that expire after 7 days."""
    return facts.where(F.col("trust_tier") == 4).select(
        "id", F.col("type").alias("proposed_type"), F.col("name").alias("proposed_name"), F.col("content").alias("proposed_content"), "trust_tier", F.col("confidence").alias("raw_confidence"),
        F.lit("pending").alias("validation_status"), "created_at", (F.col("created_at") + 7 * DAY).alias("expires_at"),
    )


def promote(staged: DataFrame, now: int, distance: Column | None = None) -> DataFrame:
    """(id, status, reason): pending facts expire, are quarantined for the first failing check (injection, distance from the domain above
    0.6 if given, confidence below 0.75 for external and 0.6 for other facts), or are promoted. Others keep their status."""
    least = F.when(F.col("trust_tier") >= 4, 0.75).otherwise(0.6)
    reason = F.when(injection_score(F.col("proposed_content")) > 0.3, "pattern_injection")
    if distance is not None:
        reason = reason.when(distance > 0.6, "off_domain")
    reason = reason.when(F.col("raw_confidence") < least, "low_confidence")
    pending = F.col("validation_status") == "pending"
    status = F.when(~pending, F.col("validation_status")).when(F.col("expires_at") < now, "expired").when(reason.isNotNull(), "quarantined").otherwise("passed")
    rows = staged.withColumn("status", status).withColumn("reason", F.when(status == "quarantined", reason))
    return rows.select("id", "status", "reason")


def infer_edges(fresh: DataFrame, nodes: DataFrame, k: int = 5, least: float = 0.3) -> DataFrame:
    """(from_id, to_id, type, weight): for each new node its k strongest links by shared package, shared tags or Bug/Solution affinity.

    Tags in common are found by an equi-join with classes of nodes: of those with the same tags that are alike in being a Bug, a Solution or
    neither, and, for links within a package, of the same package, only the first k + 1 by id can be among anyone's k strongest. Without any, a common package weighs 0.3 and a Bug and a Solution 0.35, always: there the
    first k by id of the package or of the other type are enough, as whatever else stands before them is found by its tags. A new node
    without tags has links only if it is a Bug or a Solution, and only to nodes with tags: two nodes without any tag have no link.
    """
    n = nodes.where(is_active()).select("id", "type", "package_path", F.array_distinct(F.coalesce("tags", F.array().cast("array<string>"))).alias("tags"))
    a = n.join(fresh.select("id"), "id", "left_semi").withColumnsRenamed({c: f"a_{c}" for c in n.columns})
    a = a.where("size(a_tags) > 0 or a_type in ('Bug', 'Solution')").withColumn("bare", F.expr("size(a_tags) = 0"))
    b = n.withColumnsRenamed({c: f"b_{c}" for c in n.columns})
    # lists of their own for new nodes without tags; one more than k, as a node may be in its own package's list
    some = b.withColumn("bare", F.explode(F.when(F.size("b_tags") > 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    first = lambda c: top_k(some.where(F.col(c).isNotNull()), [c, "bare"], [F.asc("b_id")], k + 1).drop("r")
    common = F.array_intersect("a_tags", "b_tags")
    opposed = F.col("a_type").isin("Bug", "Solution") & F.col("b_type").isin("Bug", "Solution") & (F.col("a_type") != F.col("b_type"))
    # each pair comes once: by its smallest common tag, else by its types, else by its package
    kind = F.when(F.col("b_type").isin("Bug", "Solution"), F.col("b_type")).otherwise("")
    tagged = b.where("size(b_tags) > 0").withColumn("kind", kind).withColumn("set", F.array_join(F.array_sort("b_tags"), "\x00"))
    anywhere = top_k(tagged, ["kind", "set"], [F.asc("b_id")], k + 1).drop("r", "kind", "set").withColumn("t", F.explode("b_tags"))
    inside = top_k(tagged.where("b_package_path is not null"), ["b_package_path", "kind", "set"], [F.asc("b_id")], k + 1).drop("r", "kind", "set").withColumn("t", F.explode("b_tags"))
    asked, same_package = a.withColumn("t", F.explode("a_tags")), F.coalesce(F.col("a_package_path") == F.col("b_package_path"), F.lit(False))
    by_tag = asked.join(anywhere, "t").where((F.col("t") == F.array_min(common)) & ~same_package)
    by_tag = by_tag.unionByName(asked.join(inside.withColumn("a_package_path", F.col("b_package_path")), ["t", "a_package_path"]).where(F.col("t") == F.array_min(common))).drop("t", "bare")
    by_package = a.join(first("b_package_path").withColumn("a_package_path", F.col("b_package_path")), ["a_package_path", "bare"]).where((F.size(common) == 0) & ~F.coalesce(opposed, F.lit(False))).drop("bare")
    opposite = first("b_type").where("b_type in ('Bug', 'Solution')").withColumn("a_type", F.when(F.col("b_type") == "Bug", "Solution").otherwise("Bug"))
    by_type = a.join(F.broadcast(opposite), ["a_type", "bare"]).where(F.size(common) == 0).drop("bare")  # at most 4 * (k + 1) rows
    pairs = by_tag.unionByName(by_package).unionByName(by_type).where("a_id <> b_id")
    overlap = array_jaccard(F.col("a_tags"), F.col("b_tags"))
    same = F.when(F.col("a_package_path") == F.col("b_package_path"), 0.3 + 0.4 * overlap).otherwise(0.0)
    label = F.when((F.col("a_type") == "Solution") & (F.col("b_type") == "Bug"), "solves").when((F.col("a_type") == "Bug") & (F.col("b_type") == "Solution"), "solved_by")
    affinity = F.when(label.isNotNull(), 0.35 + 0.55 * overlap).otherwise(0.0)
    plain = F.greatest(same, overlap)
    rows = pairs.select(F.col("a_id").alias("from_id"), F.col("b_id").alias("to_id"), F.when(affinity > plain, label).otherwise("relates_to").alias("type"), F.round(F.greatest(plain, affinity), 9).alias("weight"))
    return top_k(rows.where(F.col("weight") >= least), ["from_id"], [F.desc("weight"), F.asc("to_id")], k).drop("r")


# ---- decay and lifecycle ------------------------------------------------------------------------------------------


def importance_after(now: int) -> Column:
    """Importance halves per half-life since the last access; edges hold it up, more than 20 of them keep it at 0.25."""
    days = (F.lit(now) - F.col("last_accessed")) / F.lit(float(DAY))
    value = F.col("base_importance") * F.pow(F.lit(0.5), days / _lookup(F.col("type"), IMPORTANCE_HALF_LIFE, 30.0)) + F.least(0.02 * F.col("edge_count"), F.lit(0.3))
    return F.greatest(value, F.lit(0.01), F.when(F.col("edge_count") > 20, 0.25).otherwise(0.0))


def confidence_after(now: int, unchanged: Column | None = None) -> Column:
    """Confidence after time without access: code facts (tier 2) hold exactly while their source is unchanged, others decay."""
    days = (F.lit(now) - F.col("last_accessed")) / F.lit(float(DAY))
    pick = lambda i: F.when(F.col("trust_tier") == 1, USER_DECAY[i]).when(F.col("trust_tier") == 4, EXTERNAL_DECAY[i]).otherwise(_lookup(F.col("type"), {k: v[i] for k, v in CONFIDENCE_DECAY.items()}, CONFIDENCE_DECAY["Decision"][i]))
    decayed = F.col("base_confidence") * F.exp(-F.log(F.lit(2.0)) / pick(0) * pick(1) * days)
    return F.when(F.col("trust_tier") == 2, F.when(F.coalesce(unchanged, F.lit(False)) if unchanged is not None else F.lit(False), 1.0).otherwise(0.0)).otherwise(decayed)


def archivable(nodes: DataFrame, now: int) -> DataFrame:
    """Active nodes of importance below 0.05, without edges, not used for 90 days."""
    return nodes.where(is_active() & (F.col("importance") < 0.05) & (F.col("edge_count") == 0) & (F.col("last_accessed") < now - 90 * DAY))


def dependencies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source_path, node_id, dep_type): files that define a node, and files of nodes that it pertains to; defining counts first."""
    files = nodes.where(is_active()).select(F.col("id").alias("node_id"), F.explode("file_paths").alias("source_path"))
    about = edges.where("t_valid_until is null and type = 'pertains_to'").select("from_id", F.col("to_id").alias("node_id")).join(files, "node_id").select("source_path", F.col("from_id").alias("node_id"))
    both = files.withColumn("dep_type", F.lit("defines")).unionByName(about.withColumn("dep_type", F.lit("pertains_to")))
    return both.groupBy("source_path", "node_id").agg(F.min("dep_type").alias("dep_type"))


def stale_reads(nodes: DataFrame, deps: DataFrame, mtimes: DataFrame) -> DataFrame:
    """(id, state): fresh without sources or with none newer; rotten if a source is gone or changed over 5 minutes after; else stale.
    mtimes: (source_path, mtime)."""
    d = deps.join(mtimes, "source_path", "left").groupBy(F.col("node_id").alias("id")).agg(F.max("mtime").alias("newest"), F.count_if(F.col("mtime").isNull()).alias("gone"))
    n = nodes.where(is_active()).select("id", "created_at").join(d, "id", "left")
    late = F.col("newest") - F.col("created_at")
    return n.select("id", F.when(F.col("gone").isNull(), "fresh").when(F.col("gone") > 0, "rotten").when(late <= 0, "fresh").when(late <= 300_000, "stale").otherwise("rotten").alias("state"))


def sole_source(deps: DataFrame, deleted: DataFrame) -> DataFrame:
    """(node_id): nodes all of whose source files were deleted (source_path)."""
    d = deps.join(deleted.select("source_path", F.lit(True).alias("gone")).distinct(), "source_path", "left")
    return d.groupBy("node_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("gone").alias("k")).where("n = k").select("node_id")


def file_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, name, action) for symbols (path, name, content): insert, replace (content differs), invalidate, or keep."""
    o, n = old.select("path", "name", F.col("content").alias("o"), F.lit(True).alias("was")), new.select("path", "name", F.col("content").alias("n"), F.lit(True).alias("now"))
    action = F.when(F.col("was").isNull(), "insert").when(F.col("now").isNull(), "invalidate").when(F.col("o").eqNullSafe(F.col("n")), "keep").otherwise("replace")
    return o.join(n, ["path", "name"], "full").select("path", "name", action.alias("action"))


def changed_files(files: DataFrame, cache: DataFrame, most: int = 200) -> DataFrame:
    """Files (path, hash) whose hash the cache (path, hash) doesn't have, the first `most` by path: the batch of one run."""
    return files.join(cache.select("path", "hash"), ["path", "hash"], "left_anti").orderBy("path").limit(most)


# ---- duplicates, conflicts, sync ----------------------------------------------------------------------------------


def content_pairs(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b, type, similarity, verdict): pairs of active nodes of one type by word similarity of their content: above 0.92 merged, above
    0.5 related. Every other pair of a type is different and has no row; so are contents without words. Names play no part.

    Nothing is lost: with the words of each content in one order, rarest first, two contents more than half alike share a word within
    the first half of both (rounded up), and differ in less than a third of their words, which bitmaps of the words show from below.
    Equal word sets are one class; a word of many classes is compared in pairs of blocks.
    """
    n = nodes.where(is_active()).select("id", "type", F.array_sort(word_set(F.col("content"))).alias("w")).where("size(w) > 0")
    # a class of m ids gives m * (m - 1) / 2 pairs, so that its list of ids is small beside the result
    sets = n.groupBy("type", F.md5(F.concat_ws(" ", "w"))).agg(F.first("w").alias("w"), F.collect_list("id").alias("ids"))
    sets = materialize(sets.select(F.monotonically_increasing_id().alias("c"), "type", "w", "ids"), "sets")
    # until the contents themselves are compared, a hash stands for a word of a type
    words = sets.select("c", F.size("w").alias("n"), F.explode(F.transform("w", lambda x: F.xxhash64("type", x))).alias("x"))
    count = words.groupBy("x").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    # words of one content alone come first in the order and meet none: only their number matters
    ranked = words.join(count, "x").groupBy("c", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("w"))
    ranked = ranked.withColumn("alone", F.col("n") - F.size("w"))
    maps = [f"m{i}" for i in range(BITMAP)]
    for i, m in enumerate(maps):
        ranked = ranked.withColumn(m, F.expr(f"aggregate(filter(w, x -> pmod(x, {64 * BITMAP}) div 64 = {i}), 0L, (a, x) -> a | shiftleft(1L, cast(pmod(x, 64) as int)))"))
    half = F.greatest(F.ceil(F.col("n") / 2).cast("int") - F.col("alone"), F.lit(0))
    lead = ranked.select("c", "n", "alone", *maps, F.posexplode(F.slice("w", F.lit(1), half)).alias("i", "x")).withColumn("left", F.col("n") - F.col("alone") - F.col("i"))
    lead = materialize(lead.drop("i"), "lead")
    parts = lead.groupBy("x").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("x", F.ceil(F.col("k") / block).cast("int").alias("k"))
    lead = lead.join(parts, "x").withColumn("own", F.pmod(F.xxhash64("c"), F.col("k")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).drop("k")
    one, two = (lead.withColumnsRenamed({"own": p, "other": q} | {c: f"{c}_{s}" for c in ("c", "n", "alone", "left", *maps)}) for s, p, q in (("a", "p", "q"), ("b", "q", "p")))
    both = F.col("n_a") + F.col("n_b")
    # at the first common word, that one and what follows it in both must be enough
    enough = 3 * F.least("left_a", "left_b") > both
    unlike = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{m}_a").bitwiseXOR(F.col(f"{m}_b"))) for m in maps], F.col("alone_a") + F.col("alone_b"))
    met = one.join(two, ["x", "p", "q"]).where((F.col("c_a") < F.col("c_b")) & enough & (3 * unlike < both)).select("c_a", "c_b").distinct()
    side = lambda s: sets.select(F.col("c").alias(f"c_{s}"), F.col("w").alias(f"w_{s}"), F.col("ids").alias(f"ids_{s}"), F.col("type").alias(f"type_{s}"))
    alike = met.join(side("a"), "c_a").join(side("b"), "c_b").select(F.col("type_a").alias("type"), "ids_a", "ids_b", array_jaccard(F.col("w_a"), F.col("w_b")).alias("s")).where("s > 0.5")
    pair = lambda d: d.withColumn("i", F.explode("ids_a")).withColumn("j", F.explode("ids_b"))
    copies = sets.where("size(ids) > 1").select("type", F.col("ids").alias("ids_a"), F.col("ids").alias("ids_b"), F.lit(1.0).alias("s"))
    rows = pair(alike).unionByName(pair(copies).where("i < j"))
    s = F.col("s")
    return rows.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "type", F.round(s, 6).alias("similarity"), F.when(s > 0.92, "merged").otherwise("related").alias("verdict"))


def peer_verdict(name_similarity: Column, cosine: Column) -> Column:
    """merged, pending or different for a local and a peer's node, by names first, then by vectors."""
    return F.when(name_similarity > 0.95, "merged").when(cosine > 0.92, "merged").when(cosine >= 0.8, "pending").otherwise("different")


def merged_importance(rows: DataFrame, now: int) -> DataFrame:
    """(key, importance, trust_tier, tags): nodes of one key merged: importance weighted by e**(-0.01 days), best known tier, all tags."""
    w = F.exp(-0.01 * (F.lit(now) - F.col("created_at")) / F.lit(float(DAY)))
    tags = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("tags", F.array().cast("array<string>"))))))
    return rows.groupBy("key").agg((F.sum(F.col("importance") * w) / F.sum(w)).alias("importance"), F.max("trust_tier").alias("trust_tier"), tags.alias("tags"))


def hlc_pack(wall: Column, counter: Column) -> Column:
    return F.shiftleft(wall.cast("long"), 16).bitwiseOR(counter.cast("long"))


def hlc_unpack(c: Column) -> tuple[Column, Column]:
    return F.shiftright(c, 16), c.bitwiseAND(F.lit(0xFFFF))


def hlc_receive(local: Column, remote: Column, now: Column) -> Column:
    """The clock after a message: later than both clocks; a full counter carries into the wall time."""
    (lw, lc), (rw, rc) = hlc_unpack(local), hlc_unpack(remote)
    wall = F.greatest(lw, rw, now.cast("long"))
    counter = F.when((wall == lw) & (wall == rw), F.greatest(lc, rc) + 1).when(wall == lw, lc + 1).when(wall == rw, rc + 1).otherwise(F.lit(0).cast("long"))
    return F.when(counter > 0xFFFF, hlc_pack(wall + 1, F.lit(0))).otherwise(hlc_pack(wall, counter))


def to_push(nodes: DataFrame) -> DataFrame:
    """Nodes to send: not private, and never sent or changed since. Needs visibility, hlc_modified, synced_at."""
    return nodes.where((F.col("visibility") != "private") & (F.col("synced_at").isNull() | (F.col("synced_at") < F.col("hlc_modified"))))


def examination(events: DataFrame) -> DataFrame:
    """(rank_position, n, p): chance that a position is looked at, from clicks smoothed by a prior worth five looks."""
    prior = _lookup(F.col("rank_position"), EXAMINATION, 0.15)
    g = events.groupBy("rank_position").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("signal_strength") > 0).alias("k"))
    return g.select("rank_position", "n", ((prior * 5 + F.col("k")) / (F.col("n") + 5)).alias("p"))


def ips_weight(p: Column, synthetic: Column, most: float = 10.0) -> Column:
    return F.when(synthetic, 1.0).otherwise(F.least(1.0 / F.greatest(p, F.lit(0.01)), F.lit(most)))


def centroid(vectors: DataFrame) -> DataFrame:
    """(centroid): the mean of all vectors (v), element by element."""
    return vectors.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("x")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))
