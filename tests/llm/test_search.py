import numpy as np

from chronoloom.llm import neighbours


def test_search_gives_the_k_nearest_others(spark):
    """k rows a query with exact cosines: copies first, never the query itself, also for a query that is like no other vector."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal((12, 384))
    v = np.concatenate([b + 0.3 * rng.standard_normal((9, 384)) for b in base] + [rng.standard_normal((2, 384))]).astype(np.float32)
    v = np.concatenate([v, v[-1:], v[:1]])  # a copy of a lonely vector, and one of the first
    ids = [f"n{i:03}" for i in range(len(v))]
    df = spark.createDataFrame([("embedding", i, x.tolist()) for i, x in zip(ids, v, strict=True)], "field string, id string, vector array<float>")
    g = neighbours.VectorGraph(df, {"embedding": 384}, 0.8)
    asked = g.members().selectExpr("id q", "cid", "id")
    got: dict = {}
    for r in g.nearest(asked, 5).collect():
        got.setdefault(r.q, []).append((-r.similarity, r.id))
    u = v / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    cos = u @ u.T
    at = {x: n for n, x in enumerate(ids)}
    hit = 0
    for n, q in enumerate(ids):
        mine = sorted(got[q])
        assert len(mine) == 5 and q not in [i for _, i in mine]
        assert all(abs(-s - cos[n, at[i]]) < 1e-6 for s, i in mine)
        others = sorted((-cos[n, m], i) for i, m in at.items() if i != q)[:5]
        hit += len({i for _, i in others} & {i for _, i in mine})
    assert hit >= 0.9 * 5 * len(ids)
    assert sorted(got[ids[-2]])[0][1] == ids[-3] and sorted(got[ids[-1]])[0][1] == ids[0]


def test_search_for_vectors_from_outside(spark):
    """Queries need not be in the collection: an equal vector comes first, unusable queries have no hits."""
    rng = np.random.default_rng(3)
    v = np.concatenate([b + 0.3 * rng.standard_normal((9, 384)) for b in rng.standard_normal((12, 384))]).astype(np.float32)
    df = spark.createDataFrame([("embedding", f"n{i:03}", x.tolist()) for i, x in enumerate(v)], "field string, id string, vector array<float>")
    g = neighbours.VectorGraph(df, {"embedding": 384}, 0.8)
    near = [(f"q{i}", "embedding", None, (v[9 * i] + 0.1 * rng.standard_normal(384).astype(np.float32)).tolist()) for i in range(12)]
    others = [("same", "embedding", None, v[5].tolist()), ("short", "embedding", None, [1.0]), ("zero", "embedding", None, [0.0] * 384), ("none", "embedding", None, None)]
    asked = spark.createDataFrame(near + others, "q string, field string, id string, vector array<float>")
    got: dict = {}
    for r in g.nearest(asked, 3).collect():
        got.setdefault(r.q, []).append((-r.similarity, r.id))
    assert set(got) == {q for q, *_ in near} | {"same"} and all(len(x) == 3 for x in got.values())
    assert min(got["same"])[1] == "n005"
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    hit = sum(len({f"n{j:03}" for j in np.argsort(-(u @ np.array(x)))[:3]} & {i for _, i in got[q]}) for q, _, _, x in near)
    assert hit >= 0.9 * 36


def test_dense_group_without_comparing_all(spark):
    """Every vector is at least 0.8 similar to every other: lists are full of near ties, and no block is compared all with all."""
    rng = np.random.default_rng(5)
    n, axes = 3000, np.linalg.qr(rng.standard_normal((384, 11)))[0].T
    v = (np.sqrt(0.9) * axes[0] + np.sqrt(0.1 / 10) * rng.standard_normal((n, 10)) @ axes[1:]).astype(np.float32)
    df = spark.createDataFrame([(f"n{i:04}", x.tolist(), None) for i, x in enumerate(v)], "id string, embedding array<float>, embedding_code array<float>")
    got = {(r.id_a, r.id_b) for r in neighbours.neighbour_pairs(df).collect()}
    u = v / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(f"n{min(a, b):04}", f"n{max(a, b):04}") for a in range(n) for b in np.argsort(-s[a])[:5] if s[a, b] >= 0.8}
    assert len(got & want) >= 0.95 * len(want)
