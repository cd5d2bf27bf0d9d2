"""The most similar vectors of every vector: NN-descent on Spark.

Every vector is reduced once to a sketch of SKETCH signed bytes (a random orthogonal projection) and to its exact values in as
few bytes as hold them without loss. A first graph comes from windows of rows sorted by random hyperplane signs. Each round of
NN-descent then joins neighbours of neighbours: the sketches of a node's neighbours, in both directions, are sent to the node,
compared there, and a pair is kept where it improves the list of one of its ends; only pairs with a new neighbour are
compared. At the end the lists are settled by exact cosines, for which vectors are sent once per block of a graph
neighbourhood rather than once per pair, and the last round of NN-descent runs there, on the exact vectors of each node's
neighbours. New queries are answered by greedy search on the graph.

Equal vectors are one class. A class hands on its smallest K + 1 ids: no other of its members can be among anyone's K first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.orphans import key_filter, may_exist
from chronoloom.session import discard, materialize

#: Bytes of a sketch. The cosine it gives is off by at most about (1 - cos**2) / sqrt(SKETCH).
SKETCH = 128
#: Sorted tables for the first graph, bits of their keys, and rows compared at a time.
TABLES, KEY_BITS, WINDOW = 8, 20, 1024
#: Length of the neighbour lists in the graph, and neighbours of a node used per round in both directions together.
LIST, FAN = 24, 24
#: Rounds at most, and the share of changed list entries at which to stop.
ROUNDS, ENOUGH = 4, 0.01
#: The graph keeps pairs whose sketches are this much less similar than what is asked for, three standard deviations of a
#: sketch's error at 0.8; unlike pairs that only seem similar stay few. Exact cosines are taken within CHECK.
SLACK, CHECK = 0.1, 0.1
#: Pairs of a block above which it is split; every block, whole or split, is settled in the same way.
BLOCK = 20_000


# ---- vectors ------------------------------------------------------------------------------------------------------


def pack(m: np.ndarray) -> list[bytes]:
    """Each row in the smallest of: int8 with a power of two as scale, float16, float32, that gives the values back exactly."""
    out = []
    scaled = m * np.float32(256)
    eight = np.all((scaled == np.rint(scaled)) & (np.abs(scaled) <= 127), axis=1)
    half = np.all(m.astype(np.float16).astype(np.float32) == m, axis=1)
    for i in range(len(m)):
        if eight[i]:
            out.append(b"\x01" + scaled[i].astype(np.int8).tobytes())
        elif half[i]:
            out.append(b"\x02" + m[i].astype(np.float16).tobytes())
        else:
            out.append(b"\x04" + m[i].astype(np.float32).tobytes())
    return out


def unpack(blobs: list[bytes]) -> np.ndarray:
    """Rows of unit length, float64."""
    kinds = {1: np.int8, 2: np.float16, 4: np.float32}
    m = np.array([np.frombuffer(b, kinds[b[0]], offset=1) for b in blobs], np.float64)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _projection(dim: int, columns: int, seed: int) -> np.ndarray:
    """Random columns, orthogonal where there are no more of them than rows: these keep cosines better than independent ones."""
    g = np.random.default_rng([dim, seed]).standard_normal((dim, columns))
    if columns <= dim:
        g = np.linalg.qr(g)[0] * np.sqrt(dim)
    return g.astype(np.float32)


def sketches_of(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sketch int8, sort keys int64 per table) of rows of one dimension."""
    unit = m / np.linalg.norm(m.astype(np.float64), axis=1, keepdims=True).astype(np.float32)
    p = unit @ (_projection(m.shape[1], SKETCH, 1) / np.float32(np.sqrt(SKETCH)))
    sketch = np.clip(np.rint(p * np.float32(127 * np.sqrt(SKETCH) / 5)), -127, 127).astype(np.int8)
    signs = sketch.astype(np.float32) @ _projection(SKETCH, TABLES * KEY_BITS, 2) > 0
    keys = signs.reshape(len(m), TABLES, KEY_BITS) @ (1 << np.arange(KEY_BITS - 1, -1, -1, dtype=np.int64))
    return sketch, keys.astype(np.int64)


def packed_vectors(vectors: DataFrame, dims: dict[str, int]) -> DataFrame:
    """(field, id, vkey, packed, sketch, keys) of the usable vectors in (field, id, vector): full length, no NaN or infinity, not
    only zeros."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = np.array(b.column("field").to_pylist())
            for f, dim in dims.items():
                own = b.filter(pa.array(names == f))
                if not own.num_rows:
                    continue
                m = own.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(own.num_rows, dim)
                sketch, keys = sketches_of(m)
                blobs = pa.array(pack(m), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [own.column("field"), own.column("id"), blobs, pa.array([r.tobytes() for r in sketch], pa.binary()), pa.array(list(keys), pa.list_(pa.int64()))],
                    names=["field", "id", "packed", "sketch", "keys"],
                )

    usable = F.lit(False)
    for f, dim in dims.items():
        usable = usable | ((F.col("field") == f) & (F.size("vector") == dim))
    v = F.col("vector")
    clean = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    good = vectors.select("field", "id", F.col("vector").cast("array<float>").alias("vector")).where(F.col("id").isNotNull() & usable & clean)
    return good.mapInArrow(rows, "field string, id string, packed binary, sketch binary, keys array<long>").withColumn("vkey", F.unhex(F.md5("packed")))


# ---- graph --------------------------------------------------------------------------------------------------------

EDGE = "u long, v long, s float"


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    m = np.frombuffer(b"".join(rows), np.int8).reshape(len(rows), SKETCH).astype(np.float32)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)


def _edge_batch(u, v, s):
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(s.astype(np.float32))], names=["u", "v", "s"])


def first_graph(points: DataFrame, floor: float, asked: DataFrame | None = None) -> DataFrame:
    """(u, v, s) from windows of the sorted tables: for each point its best LIST / 2 of every window, at least `floor` similar.
    asked: the only points (cid) that get lists."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(t: pa.Table):
            group, cid, m = t.column("part").to_numpy(), t.column("cid").to_numpy(), _matrix(t.column("sketch"))
            own = np.flatnonzero(t.column("asked").to_numpy())
            s = m[own] @ m.T
            s[group[own][:, None] != group[None, :]] = -2
            s[np.arange(len(own)), own] = -2
            i, j = np.nonzero(s >= floor)
            w = s[i, j]
            i = own[i]
            best = LIST // 2
            if len(i):
                order = np.lexsort((-w, i))
                i, j, w = i[order], j[order], w[order]
                starts = np.searchsorted(i, i, "left")
                keep = np.arange(len(i)) - starts < best
                yield _edge_batch(cid[i[keep]], cid[j[keep]], w[keep])

        rest = None
        for b in batches:
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            while t.num_rows >= 2 * WINDOW:
                yield from work(t.slice(0, WINDOW))
                t = t.slice(WINDOW)
            rest = t
        if rest is not None and rest.num_rows:
            half = rest.num_rows if rest.num_rows <= WINDOW else rest.num_rows // 2
            yield from work(rest.slice(0, half))
            if half < rest.num_rows:
                yield from work(rest.slice(half))

    if asked is None:
        points = points.withColumn("asked", F.lit(True))
    else:
        points = points.join(asked.select("cid", F.lit(True).alias("asked")).distinct(), "cid", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    tables = points.select("field", "cid", "sketch", "asked", F.posexplode("keys").alias("t", "k"))
    tables = tables.select(F.abs(F.xxhash64("field", "t")).alias("part"), "k", "cid", "sketch", "asked")
    ordered = tables.repartitionByRange("part", "k", "cid").sortWithinPartitions("part", "k", "cid")
    return ordered.mapInArrow(windows, EDGE)


def best_lists(edges: DataFrame, length: int = LIST) -> DataFrame:
    """The `length` most similar v of each u (ties: smaller v), each pair once; fresh tells whether the pair is new."""
    once = edges.groupBy("u", "v").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh"))
    w = Window.partitionBy("u").orderBy(F.desc("s"), "v")
    return once.withColumn("r", F.row_number().over(w)).where(F.col("r") <= length).drop("r")


def join_round(graph: DataFrame, points: DataFrame, floor: float) -> DataFrame:
    """Pairs (u, v, s) found among the neighbours of each node, where one of the two is new and the pair improves u's list."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(t: pa.Table):
            c, m, fresh, least = (t.column(x).to_numpy() for x in ("c", "m", "fresh", "least"))
            vec = _matrix(t.column("sketch"))
            at, d = np.arange(len(c)), 1
            while len(at):
                at = at[at + d < len(c)]
                at = at[c[at] == c[at + d]]
                look = at[(fresh[at] | fresh[at + d]) & (m[at] != m[at + d])]
                for lo in range(0, len(look), 65536):
                    i = look[lo : lo + 65536]
                    j = i + d
                    s = np.einsum("ij,ij->i", vec[i], vec[j])
                    for a, b in ((i, j), (j, i)):
                        ok = (s >= floor) & (s > least[a])
                        if ok.any():
                            yield _edge_batch(m[a[ok]], m[b[ok]], s[ok])
                d += 1

        rest = None
        for b in batches:
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            if not t.num_rows:
                continue
            c = t.column("c").to_numpy()
            cut = int(np.searchsorted(c, c[-1], "left"))
            if cut:
                yield from work(t.slice(0, cut))
            rest = t.slice(cut)
        if rest is not None and rest.num_rows:
            yield from work(rest)

    least = graph.groupBy("u").agg(F.count(F.lit(1)).alias("k"), F.min("s").alias("s")).select(F.col("u").alias("m"), F.when(F.col("k") >= LIST, F.col("s")).otherwise(F.lit(-1.0)).cast("float").alias("least"))
    both = graph.select(F.col("u").alias("c"), F.col("v").alias("m"), "s", "fresh").unionByName(graph.select(F.col("v").alias("c"), F.col("u").alias("m"), "s", "fresh"))
    both = both.groupBy("c", "m").agg(F.max("s").alias("s"), F.max("fresh").alias("fresh"))
    w = Window.partitionBy("c").orderBy(F.desc("fresh"), F.desc("s"), "m")
    near = both.withColumn("r", F.row_number().over(w)).where(F.col("r") <= FAN).select("c", "m", "fresh")
    info = points.select(F.col("cid").alias("m"), "sketch").join(least, "m", "left").withColumn("least", F.coalesce("least", F.lit(-1.0).cast("float")))
    sent = near.join(info, "m").select("c", "m", "fresh", "least", "sketch")
    return sent.repartition("c").sortWithinPartitions("c").mapInArrow(compare, EDGE)


def descend(points: DataFrame, floor: float) -> tuple[DataFrame, DataFrame]:
    """(first graph, graph after NN-descent): lists (u, v, s, fresh) of at most LIST neighbours, written tables."""
    start = materialize(best_lists(first_graph(points, floor).withColumn("fresh", F.lit(True))), "graph")
    graph = start
    for _ in range(ROUNDS):
        old = graph.withColumn("fresh", F.lit(False))
        found = join_round(graph, points, floor).withColumn("fresh", F.lit(True))
        after = materialize(best_lists(old.unionByName(found)), "graph")
        n, changed = after.agg(F.count(F.lit(1)), F.count_if("fresh")).first()
        if graph is not start:
            discard(graph)
        graph = after
        if changed <= ENOUGH * max(1, n):
            break
    return start, graph


# ---- exact similarity ---------------------------------------------------------------------------------------------


def _pair_cosines(m: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.concatenate([np.einsum("ij,ij->i", m[i[x : x + 8192]], m[j[x : x + 8192]]) for x in range(0, len(i), 8192)] or [np.zeros(0)])


def _joined_once(m: np.ndarray, i: np.ndarray, j: np.ndarray, cos: np.ndarray, k: int, emit: float) -> tuple[np.ndarray, np.ndarray]:
    """New pairs x < y of rows of m, from one round of NN-descent on the pairs (i, j, cos): the FAN best neighbours of each row are compared
    with one another, and a pair is kept where it is at least `emit` similar and betters the k + 1 best of one of the two."""
    n = len(m)
    u, v, c = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([cos, cos])
    order = np.lexsort((-c, u))
    u, v, c = u[order], v[order], c[order]
    at = np.arange(len(u)) - np.searchsorted(u, u, "left")
    least = np.full(n, emit, np.float32)
    last = at == k
    least[u[last]] = np.maximum(emit, c[last])
    least -= np.float32(1e-4)  # of the single precision below
    u, v = u[at < FAN], v[at < FAN]
    heads = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]])) if len(u) else np.zeros(0, int)
    single, known = m.astype(np.float32), np.unique(np.minimum(i, j) * n + np.maximum(i, j))
    out = [np.zeros(0, np.int64)]
    for lo, hi in zip(heads, np.append(heads[1:], len(u)), strict=True):
        if hi - lo > 1:
            r = v[lo:hi]
            s = single[r] @ single[r].T
            x, y = np.nonzero(np.triu(s >= np.minimum(least[r][:, None], least[r][None, :]), 1))
            if len(x):
                out.append(np.minimum(r[x], r[y]) * n + np.maximum(r[x], r[y]))
    new = np.setdiff1d(np.concatenate(out), known)
    return new // max(1, n), new % max(1, n)


def exact_pairs(graph: DataFrame, points: DataFrame, packed: DataFrame, least: float, k: int, emit: float) -> DataFrame:
    """(a, b, cosine) for the pairs of the graph whose sketches are at least `least` similar.

    Pairs are put into the block of the smallest node two steps around them; a block gets each vector once. Blocks of many pairs are split by a.
    Of a split block a part has the nodes a with the same smallest neighbours. In a block, beside its pairs, the neighbours of each node are
    joined with one another once more, by their exact vectors: the last round. Only pairs at least `emit` similar come out.
    """
    near = graph.where(F.col("s") >= least).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    near = materialize(near, "near")
    both = near.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(near.select(F.col("b").alias("x"), F.col("a").alias("y")))
    one = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("l"))
    two = both.join(one.withColumnsRenamed({"x": "y"}), "y").groupBy("x").agg(F.min("l").alias("l")).join(one.withColumnRenamed("l", "l1"), "x").select(F.col("x").alias("a"), F.least("l", "l1").alias("block"))
    pairs = near.join(two, "a").join(one.withColumnsRenamed({"x": "a", "l": "l1"}), "a")
    pairs = materialize(pairs.withColumn("part", F.lit(0).cast("long")), "blocks")
    sizes = materialize(pairs.groupBy("block").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > BLOCK), "sizes")
    if sizes.limit(1).count():
        # a node that many have as their smallest neighbour is split further, by a
        big = pairs.join(sizes, "block")
        hubs = big.groupBy("block", "l1").agg(F.count(F.lit(1)).alias("h")).where(F.col("h") > BLOCK)
        piece = F.pmod(F.xxhash64("a"), F.coalesce(F.ceil(F.col("h") / BLOCK), F.lit(1)))
        big = big.join(hubs, ["block", "l1"], "left").withColumn("part", F.pmod(F.xxhash64("l1", piece), F.ceil(2 * F.col("k") / BLOCK)))
        pairs = materialize(pairs.join(sizes, "block", "left_anti").unionByName(big.select(*pairs.columns)), "blocks")
    wanted = pairs.select("block", "part", F.explode(F.array("a", "b")).alias("cid")).distinct()
    keys = materialize(points.select("cid", "field", "vkey").join(wanted.select("cid").distinct(), "cid"), "keys")
    # a bounded filter leaves out the vectors of points without any pair before they are shuffled
    some = packed.select("field", "vkey", "packed").where(may_exist(key_filter(keys, "vkey"), "vkey"))
    blobs = keys.join(some.dropDuplicates(["field", "vkey"]), ["field", "vkey"]).select("cid", "packed")
    nothing = F.lit(None).cast("binary")
    rows = pairs.select("block", "part", F.lit(1).alias("kind"), "a", "b", nothing.alias("packed")).unionByName(
        wanted.join(blobs, "cid").select("block", "part", F.lit(0).alias("kind"), F.col("cid").alias("a"), F.lit(0).cast("long").alias("b"), "packed")
    )

    def cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from chronoloom.llm.near_duplicates import groups_of

        for t in groups_of(batches, ["block", "part"]):
            kind, a, b = (t.column(c).to_numpy() for c in ("kind", "a", "b"))
            n = int((kind == 0).sum())
            ids, m = a[:n], unpack(t.column("packed").slice(0, n).to_pylist())
            order = np.argsort(ids)
            i = order[np.searchsorted(ids[order], a[n:])]
            j = order[np.searchsorted(ids[order], b[n:])]
            cos = _pair_cosines(m, i, j)
            x, y = _joined_once(m, i, j, cos, k, emit)
            lo, hi = np.concatenate([np.minimum(i, j), x]), np.concatenate([np.maximum(i, j), y])
            cos = np.concatenate([cos, _pair_cosines(m, x, y)])
            ok = cos >= emit
            lo, hi, cos = ids[lo[ok]], ids[hi[ok]], cos[ok]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(lo, hi)), pa.array(np.maximum(lo, hi)), pa.array(cos)], names=["a", "b", "cosine"])

    return rows.repartition("block", "part").sortWithinPartitions("block", "part", "kind").mapInArrow(cosines, "a long, b long, cosine double")


# ---- the operator -------------------------------------------------------------------------------------------------


class VectorGraph:
    """The neighbour graph of a collection of vectors (field, id, vector), for neighbours() and search()."""

    def __init__(self, vectors: DataFrame, dims: dict[str, int], least: float) -> None:
        """least: the smallest cosine that neighbours may have; the graph isn't followed much below it."""
        self.least, self.dims = least, dims
        self.packed = materialize(packed_vectors(vectors, dims), "packed")
        classes = self.packed.groupBy("field", "vkey").agg(F.first("sketch").alias("sketch"), F.first("keys").alias("keys"))
        self.points = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "points")
        self.first, self.graph = descend(self.points, least - SLACK)

    def members(self) -> DataFrame:
        return self.packed.select("field", "id", "vkey").distinct().join(self.points.select("field", "vkey", "cid"), ["field", "vkey"]).select("field", "id", "cid")

    def neighbours(self, k: int) -> DataFrame:
        """(field, id, neighbour, cosine): the k most similar others of every vector (ties: smaller id), at least `least` similar."""
        members = materialize(self.members(), "members")
        by_id = Window.partitionBy("cid").orderBy("id")
        heads = members.select("cid", "id").withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= k + 1).drop("r")
        pairs = materialize(exact_pairs(self.graph, self.points, self.packed, self.least - CHECK, k, self.least).groupBy("a", "b").agg(F.max("cosine").alias("cosine")), "pairs")
        to = pairs.select(F.col("a").alias("u"), F.col("b").alias("cid"), "cosine").unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("cid"), "cosine"))
        copies = heads.groupBy("cid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("cid").alias("u"), "cid", F.lit(1.0).alias("cosine"))
        order = Window.partitionBy("u").orderBy(F.desc("cosine"), "id")
        top = to.unionByName(copies).join(heads, "cid").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
        lists = top.groupBy("u").agg(F.array_sort(F.collect_list(F.struct("r", "id", "cosine"))).alias("l")).withColumnRenamed("u", "cid")
        own = members.join(lists, "cid").withColumn("l", F.slice(F.filter("l", lambda x: x["id"] != F.col("id")), 1, k))
        return own.select("field", F.col("id").alias("of"), F.inline("l")).select("field", F.col("of").alias("id"), F.col("id").alias("neighbour"), "cosine")

    def search(self, queries: DataFrame, k: int, beam: int = LIST, steps: int = 4) -> DataFrame:
        """(q, v, s): the class equal to each query, if there is one, and the `beam` other classes (at least k) that greedy search on the graph
        finds most similar, with exact cosines; nearest() cuts them to k. queries: (q, cid) for vectors of the collection, or (q, field,
        vector) for any others, each q once; unusable ones have no hits. A query starts from its own node and, as that may have no list, from
        the windows of the sorted tables where it stands; every step looks at the neighbours of the beam, in sketches, and keeps the
        `beam` best. The search ends when no beam changes; then exact cosines are taken."""
        beam = max(beam, k) + 1  # the query's own node is walked through, but no hit
        points, packed = self.points, self.packed
        if "cid" in queries.columns:
            queries = materialize(queries.select("q", "cid").distinct(), "queries")
            own = queries.select("q", F.col("cid").alias("v"))
        else:
            guests = packed_vectors(queries.select("field", F.col("q").alias("id"), "vector"), self.dims).withColumn("cid", -1 - F.monotonically_increasing_id())
            guests = materialize(guests, "guests")
            points, packed = points.unionByName(guests.select(*points.columns)), packed.unionByName(guests.select(*packed.columns))
            queries = guests.select(F.col("id").alias("q"), "cid")
            own = guests.select(F.col("id").alias("q"), "field", "vkey").join(self.points.select("field", "vkey", F.col("cid").alias("v")), ["field", "vkey"]).select("q", "v")
        graph = self.graph.select("u", "v").unionByName(self.graph.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
        sk = self.points.select(F.col("cid").alias("v"), F.col("sketch").alias("y"))
        mine = queries.join(points.select("cid", F.col("sketch").alias("x")), "cid").select("q", "x")
        order = Window.partitionBy("q").orderBy(F.desc("s"), "v")
        best = lambda d, n: d.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n).drop("r")
        near = first_graph(points, -1.5, queries).where("v >= 0").groupBy("u", "v").agg(F.max("s").alias("s"))
        start = near.join(queries.withColumnRenamed("cid", "u"), "u").join(own, ["q", "v"], "left_anti").select("q", "v", "s")
        start = start.unionByName(own.withColumn("s", F.lit(2.0).cast("float")))
        state = materialize(best(start.withColumn("fresh", F.lit(True)), beam), "beam")

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    s = np.einsum("ij,ij->i", _matrix(b.column("x")), _matrix(b.column("y"))).astype(np.float32)
                    yield pa.RecordBatch.from_arrays([b.column("q"), b.column("v"), pa.array(s)], names=["q", "v", "s"])

        for _ in range(steps):
            ahead = state.where("fresh").select("q", F.col("v").alias("u")).join(graph, "u").select("q", "v").distinct()
            ahead = ahead.join(state.select("q", "v"), ["q", "v"], "left_anti")
            scored = ahead.join(mine, "q").join(sk, "v").select("q", "v", "x", "y").mapInArrow(score, "q string, v long, s float").withColumn("fresh", F.lit(True))
            state = materialize(best(state.withColumn("fresh", F.lit(False)).unionByName(scored), beam), "beam")
            if not state.where("fresh").limit(1).count():
                break
        pairs = state.select("q", "v").join(own, ["q", "v"], "left_anti").join(queries, "q").select("q", "cid", "v")
        return self._cosines(pairs, points, packed).unionByName(own.withColumn("s", F.lit(1.0)))

    def _cosines(self, pairs: DataFrame, points: DataFrame, packed: DataFrame) -> DataFrame:
        """(q, v, s) with the exact cosine of the classes cid and v of each pair (q, cid, v)."""

        def cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                fields = np.array(b.column("field").to_pylist())
                for f in np.unique(fields):
                    part = b.filter(pa.array(fields == f))
                    for lo in range(0, part.num_rows, 4096):
                        some = part.slice(lo, 4096)
                        x, y = (unpack(some.column(c).to_pylist()) for c in ("x", "y"))
                        yield pa.RecordBatch.from_arrays([some.column("q"), some.column("v"), pa.array(np.einsum("ij,ij->i", x, y))], names=["q", "v", "s"])

        wanted = pairs.select(F.explode(F.array("cid", "v")).alias("cid")).distinct()
        keys = materialize(points.select("cid", "field", "vkey").join(wanted, "cid"), "keys")
        some = packed.select("field", "vkey", "packed").where(may_exist(key_filter(keys, "vkey"), "vkey"))
        blobs = materialize(keys.join(some.dropDuplicates(["field", "vkey"]), ["field", "vkey"]).select("cid", "field", "packed"), "blobs")
        x = blobs.withColumnRenamed("packed", "x")
        y = blobs.select(F.col("cid").alias("v"), F.col("packed").alias("y"))
        return pairs.join(x, "cid").join(y, "v").select("q", "v", "field", "x", "y").mapInArrow(cosines, "q string, v long, s double")

    def nearest(self, queries: DataFrame, k: int) -> DataFrame:
        """(q, id, similarity): the k vectors most similar to each query, copies of it included (ties: smaller id). queries as for
        search(), with the id of the query's own row, which is no hit; null for none."""
        heads = self.members().select(F.col("cid").alias("v"), F.col("id")).withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1).drop("r")
        rows = self.search(queries, k).join(heads, "v").join(queries.select("q", F.col("id").alias("own")), "q").where("own is null or id <> own")
        order = Window.partitionBy("q").orderBy(F.desc("s"), "id")
        return rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("q", "id", F.col("s").alias("similarity"))


def stored_vectors(nodes: DataFrame) -> DataFrame:
    """(field, id, vector) of both vector columns of graph_nodes."""
    return nodes.select("id", F.lit("embedding").alias("field"), F.col("embedding").alias("vector")).where("vector is not null").unionByName(
        nodes.select("id", F.lit("embedding_code").alias("field"), F.col("embedding_code").alias("vector")).where("vector is not null")
    )


DIMS = {"embedding": 384, "embedding_code": 768}


def neighbour_pairs(nodes: DataFrame, k: int = 5, least: float = 0.8) -> DataFrame:
    """(field, id_a, id_b), id_a < id_b: pairs of which one is among the other's k most similar vectors and at least `least`
    similar. Null, short and long vectors, and those with NaN or only zeros, take no part; a node delivered twice counts once;
    other columns are ignored; no usable vectors give no rows."""
    n = VectorGraph(stored_vectors(nodes), DIMS, least).neighbours(k)
    return n.select("field", F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
