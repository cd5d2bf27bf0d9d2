import random
from itertools import combinations

from chronoloom.operators import maintenance as mt

PAIR_NODE = "id string, name string, type string, content string, t_valid_until long, archived_at long"


def test_like_contents_meet_whatever_their_names(spark):
    """Against all pairs: names that differ or have no word, copies, words in most contents, blocks smaller than a word's contents."""
    rng = random.Random(5)
    rows = []
    for i in range(160):
        base = random.Random(i % 23)
        words = ["the", "of", "a", *(f"w{base.randrange(60)}" for _ in range(base.randrange(1, 14)))]
        words = [w if rng.random() > 0.12 else f"v{rng.randrange(40)}" for w in words]
        rows.append((f"n{i:03}", rng.choice(["x", "i", f"name{i}"]), rng.choice(["Bug", "Concept"]), " ".join(words), None, None))
    rows += [("e1", "x", "Bug", "  ", None, None), ("e2", "x", "Bug", None, None, None), ("gone", "x", "Bug", rows[0][3], 5, None)]
    sets = {r[0]: set((r[3] or "").split()) for r in rows}
    want = {}
    for x, y in combinations([r for r in rows if r[4] is None], 2):
        a, b = sets[x[0]], sets[y[0]]
        s = len(a & b) / len(a | b) if a and b else 0
        if x[2] == y[2] and s > 0.5:
            want[(min(x[0], y[0]), max(x[0], y[0]))] = (round(s, 6), "merged" if s > 0.92 else "related")
    for block in (3, 2000):
        got = [((r.a, r.b), (r.similarity, r.verdict)) for r in mt.content_pairs(spark.createDataFrame(rows, PAIR_NODE), block).collect()]
        assert len(want) > 100 and len(got) == len(want) and dict(got) == want


EDGE_NODE = "id string, type string, package_path string, tags array<string>, t_valid_until long, archived_at long"


def test_edges_of_all_candidates(spark):
    """Against all pairs: Bugs and Solutions without common tags, and those without tags in a package, have their links."""
    rng = random.Random(3)
    kinds, packages = ["Bug", "Solution", "Decision"], [None, "p", "q"]
    rows = [(f"n{i:03}", rng.choice(kinds), rng.choice(packages), rng.choice([None, [], rng.sample("abcdefgh", rng.randrange(1, 4))]), None, None) for i in range(90)]
    want = set()
    for a in rows:
        weighed = []
        for b in rows:
            x, y = set(a[3] or []), set(b[3] or [])
            o = len(x & y) / len(x | y) if x and y else 0.0
            own, label = a[1] in ("Bug", "Solution"), {("Solution", "Bug"): "solves", ("Bug", "Solution"): "solved_by"}.get((a[1], b[1]))
            if a is b or not (x or y) or not (x or own):
                continue
            plain = max(0.3 + 0.4 * o if a[2] and a[2] == b[2] else 0.0, o)
            w = 0.35 + 0.55 * o if label else 0.0
            weighed.append((-round(max(plain, w), 9), b[0], label if w > plain else "relates_to"))
        want |= {(a[0], b, kind, -w) for w, b, kind in sorted(weighed)[:5] if -w >= 0.3}
    n = spark.createDataFrame(rows, EDGE_NODE)
    got = {tuple(r) for r in mt.infer_edges(n, n).select("from_id", "to_id", "type", "weight").collect()}
    assert got == want and any(w == 0.35 for *_, w in want)
