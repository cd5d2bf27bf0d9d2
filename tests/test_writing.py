"""The write path and readers' views: small fixtures for what the SQL of the queries doesn't show."""

import random

from pyspark.sql import functions as F

from chronoloom.operators import knowledge as kn
from chronoloom.operators import rolling, writing
from chronoloom.session import discard, materialize, release, shared_dir


def nodes(spark, rows):
    cols = "id string, name string, type string, content string, t_valid_until long, archived_at long"
    return spark.createDataFrame(rows, cols)


def test_consolidate_in_order(spark):
    old = nodes(spark, [("n1", "a", "T", "x y z", None, None), ("n0", "a", "T", "gone", 5, None), ("n2", None, "T", "x", None, None)])
    facts = [
        ("f1", 1, "a", "T", "x y z"), ("f2", 2, "a", "T", "x y w"), ("f3", 3, "a", "T", "x y w"), ("f4", 4, "a", "T", "other words here"), ("f5", 5, "a", "T", "other words here"),
        ("g1", 1, "b", "T", "new"), ("g2", 2, "b", "T", None), ("h1", 1, None, "T", "x"), ("h2", 2, None, "T", "x"),
    ]
    df = spark.createDataFrame(facts, "fact_id string, at long, name string, type string, content string").withColumn("kind", F.lit("clash")).withColumn("id", F.lit("clash"))
    got = {r.fact_id: (r.action, r.match_id) for r in writing.consolidate_in_order(df, old).collect()}
    assert got == {
        "f1": ("NOOP", "n1"), "f2": ("UPDATE", "n1"), "f3": ("NOOP", "n1"), "f4": ("INVALIDATE", "n1"), "f5": ("NOOP", "f4"),
        "g1": ("ADD", None), "g2": ("INVALIDATE", "g1"), "h1": ("ADD", None), "h2": ("ADD", None),
    }
    assert writing.consolidate_in_order(df.limit(0), old).count() == 0


def test_node_states(spark):
    base = spark.createDataFrame([("a", "s", 1, 10, None, None)], "id string, summary string, access_count long, last_accessed long, t_valid_until long, archived_at long")
    log = [("a", 5, 1, "update", "t"), ("a", 5, 2, "update", "u"), ("a", 6, 1, "update", None), ("a", 20, 1, "touch", None), ("a", 30, 1, "invalidate", None), ("a", 29, 1, "invalidate", None), ("b", 7, 1, "insert", "new"), ("c", 7, 1, "touch", None), (None, 1, 1, "insert", "x"), ("a", 99, 1, "dance", "x")]
    out = writing.node_states(base, spark.createDataFrame(log, "id string, at long, seq long, op string, summary string"), ["summary"])
    assert {r.id: tuple(r)[1:] for r in out.collect()} == {"a": ("u", 2, 20, 29, None), "b": ("new", 0, 7, None, None)}
    assert writing.node_states(base.limit(0), spark.createDataFrame([], "id string, at long, seq long, op string, summary string"), ["summary"]).count() == 0


def test_repair_json(spark):
    rows = [('```json\n{"a": 1,}\n```', '{"a": 1}'), ("[1, 2, ]", "[1, 2]"), (' {"a": 1} ', '{"a": 1}'), (None, None), ("", "")]
    df = spark.createDataFrame(rows, "t string, want string")
    assert all(r.got == r.want for r in df.select("want", writing.repair_json(F.col("t")).alias("got")).collect())


def test_files_fall_back_on_names(spark):
    n = spark.createDataFrame([("a", ["src/x.ts"], 0.5, None, None), ("b", ["lib/x.tsx", None], 0.9, None, None), ("c", None, 1.0, None, None)], "id string, file_paths array<string>, importance double, t_valid_until long, archived_at long")
    asked = spark.createDataFrame([("src/x.ts",), ("app/x.ts",), ("nothing",), (None,)], "path string")
    got = sorted((r.path, r.id, r.how) for r in kn.nodes_by_file(n, asked).collect())
    assert got == [("app/x.ts", "a", "name"), ("app/x.ts", "b", "name"), ("src/x.ts", "a", "exact")]


def test_stored_tree_takes_late_corrections(spark):
    import datetime as dt

    rnd, t = random.Random(4), dt.datetime(2025, 1, 1)
    rows = [(i, 1_740_000_000_000 + rnd.randrange(300) * 86_400_000, rnd.choice("ab"), rnd.choice([None, 0.5, 0.25]), rnd.choice([None, 3]), t) for i in range(300)]
    late = [(i, rows[i][1] + 86_400_000 * rnd.randrange(3), "a", 9.0, 1, t + dt.timedelta(days=1)) for i in range(0, 300, 40)] + [(7, rows[7][1], "b", 99.0, 1, t - dt.timedelta(days=1)), (None, rows[0][1], "c", 1.0, 1, t)]
    schema = "entry_id long, timestamp long, provider string, estimated_cost double, input_tokens long, received_at timestamp"
    first, rest = spark.createDataFrame(rows, schema), spark.createDataFrame(late, schema)
    tree = rolling.StoredTree(rolling.daily_costs(first))
    touched = tree.correct(rolling.corrections(first, rest))
    days = {r.day >> rolling.HEIGHT for r in rolling.corrections(first, rest).collect()}
    assert set(touched) == days and tree.correct(rolling.corrections(first, rest.limit(0))) == []
    want = rolling.rolling_costs(first.unionByName(rest)).collect()
    assert sorted(map(str, rolling.cost_windows(tree.nodes().drop("shard")).collect())) == sorted(map(str, want))


def test_tables_go_when_discarded(spark):
    from chronoloom.session import _file

    a, b = (materialize(spark.range(3), n) for n in "ab")
    p, fs = _file(spark, a._chronoloom_path)
    assert fs.exists(p) and a._chronoloom_path.startswith(shared_dir(spark))
    discard(a)
    assert not fs.exists(p)
    release(spark)
    assert not fs.exists(_file(spark, b._chronoloom_path)[0])


def test_workers_find_the_package_from_elsewhere(spark):
    """The workers get the package with the session: they don't depend on the folder they start in, nor on an installed copy."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys; sys.path.insert(0, {root!r})
from chronoloom.session import build_session
s = build_session("elsewhere", "local[1]", **{{"spark.log.level": "ERROR"}})
def f(batches):
    import chronoloom.session
    yield from batches
sys.path.remove({root!r})
print("rows", s.range(3).mapInArrow(f, "id long").count(), ".zip" in str(s.range(1).rdd.map(lambda _: __import__("chronoloom").__file__).first()))
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd="/", env=env, capture_output=True, text=True, timeout=120)
    assert "rows 3 True" in out.stdout, out.stdout + out.stderr[-2000:]


def test_conflicts_and_peers(spark):
    from chronoloom.operators import conflicts as cf

    words = " ".join(f"w{i}" for i in range(40))
    schema = "id string, type string, name string, content string, t_valid_from long, t_valid_until long, archived_at long, conflict_group_id string"
    rows = [
        ("a", "T", "x y", words, None, None, None, None), ("b", "T", "y x", words + " one", None, None, None, "g1"), ("c", "T", "z", words + " two", 5, None, None, None),
        ("d", "U", "x y", words, None, None, None, None), ("e", "T", None, words, None, None, None, None), ("f", "T", "q", None, None, None, None, None), ("g", "T", "q", words, None, 1, None, None), ("h", "T", "v", "far away", None, None, None, None),
    ]
    n = spark.createDataFrame(rows, schema)
    pairs = cf.conflict_pairs(n)
    # equal contents (a, e) are no conflict; 40 of 42 words (b, c) are
    assert {(r.a, r.b) for r in pairs.collect()} == {("a", "b"), ("a", "c"), ("b", "c"), ("b", "e"), ("c", "e")}
    assert {r.id: r.group_id for r in cf.conflict_groups(n, pairs).collect()} == dict.fromkeys("abce", "g1")
    near = spark.createDataFrame([("h", "a", 0.9), ("b", "a", 0.2)], "a string, b string, cosine double")
    assert {(r.a, r.b) for r in cf.conflict_pairs(n, near).collect()} == {("a", "h"), ("a", "c"), ("b", "c"), ("b", "e"), ("c", "e")}
    got = cf.peer_matches(n.where("id in ('a', 'h')"), n, near.select(F.col("a").alias("b"), F.col("b").alias("a"), "cosine").union(spark.createDataFrame([("h", "c", 0.85)], "a string, b string, cosine double").select("b", "a", "cosine")))
    assert {(r.id, r.peer_id): r.verdict for r in got.collect()} == {("a", "b"): "merged", ("a", "h"): "pending", ("h", "c"): "pending"}
    assert cf.conflict_pairs(n.limit(0)).count() == 0
    own = spark.createDataFrame([("k", 1, "team", 5), ("l", 1, "team", None)], "key string, v int, visibility string, clock long")
    other = spark.createDataFrame([("k", 2, "team", 5), ("l", 2, "team", 1), ("m", 3, "private", 9), ("o", 4, "team", None), ("p", 5, "team", 1)], own.schema)
    assert {r.key: r.v for r in cf.pulled(own, other, ["key"], "clock").collect()} == {"k": 1, "l": 2, "p": 5}
