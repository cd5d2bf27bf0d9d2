"""Orphans, snapshot changes, rolling totals, components: small cases, nulls, ties, repeats, empty tables, clashing columns, skew."""

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from chronoloom.operators import orphans, rolling, snapshot_diff
from chronoloom.operators.components import connected_components

REFS = "table_name string, field string, record_id string, ref_id string, ref_ms long, p_created string"
PARENTS = "id string, t_created long, archived_at long, ref_id string"


def found(spark, refs, parents):
    out = orphans.orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS))
    return sorted((r["record_id"], r["ref_id"], r["reason"], r["period"]) for r in out.collect())


def test_orphans(spark):
    refs = [("e", "to", "1", " A ", 100, "x"), ("e", "to", "2", "b", 100, None), ("e", "to", "3", "c", 100, None), ("e", "to", "4", "d", 100, None), ("e", "to", "5", None, 100, None), ("e", "to", "6", "  ", 1, None), ("e", "to", "7", "zz", None, None), ("e", "to", "2", "b", 100, None), ("e", "to", "8", "a", None, None)]
    parents = [("a", 50, None, "q"), ("a", 50, None, "q"), ("b", 101, None, None), ("c", 1, 100, None), ("d", 100, 101, None), (None, 1, 1, None)]
    assert found(spark, refs, parents) == [("2", "b", "later", "1970-01"), ("3", "c", "archived", "1970-01"), ("7", "zz", "missing", None)]


def test_orphans_empty(spark):
    assert found(spark, [], []) == []
    assert found(spark, [("e", "to", "1", "a", 5, None)], []) == [("1", "a", "missing", "1970-01")]
    assert found(spark, [], [("a", 1, None, None)]) == []


def test_orphans_hot_key(spark):
    refs = spark.range(30000).select(F.lit("e").alias("table_name"), F.lit("to").alias("field"), F.col("id").cast("string").alias("record_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("n"), F.col("id") % 500)).alias("ref_id"), F.lit(10).cast("long").alias("ref_ms"))
    parents = spark.createDataFrame([("hot", 11, None)] + [(f"n{i}", 1, None) for i in range(0, 500, 2)], "id string, t_created long, archived_at long")
    out = orphans.orphan_references(refs, parents)
    got = {r["reason"]: r["n"] for r in out.groupBy("reason").agg(F.count("*").alias("n")).collect()}
    missing = sum(1 for i in range(30000) if i % 3 and (i % 500) % 2)
    assert got == {"later": 10000, "missing": missing}


def test_filter_never_misses(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("ref_id"))
    f = orphans.key_filter(keys, "ref_id")
    assert keys.where(orphans.may_exist(f, "ref_id")).count() == 5000
    others = spark.range(5000).select(F.concat(F.lit("x"), "id").alias("ref_id"))
    assert others.where(orphans.may_exist(f, "ref_id")).count() < 500


SNAP = "snapshot_id long, repo_hash string, timestamp long, entities string, edges string, received_at timestamp, change string"


def changes(spark, rows):
    t = dt.datetime(2025, 1, 1)
    out = snapshot_diff.snapshot_changes(spark.createDataFrame([(*r, t, "x") for r in rows], SNAP))
    return sorted(tuple(r) for r in out.collect())


def test_snapshot_changes(spark):
    rows = [
        (1, "r", 10, '[{"id":"a","n":1,"t":"x"},{"id":"b","n":2}]', '[{"id":"e"}]'),
        (2, "r", 20, '[{"id":"broken', "[]"),
        (3, "r", 30, '[ {"t":"x", "n":1.0, "z":null, "id":"a"}, {"id":"c"}, {"id":"c"} ]', '[{"id":"e","w":0}]'),
        (4, "r", 30, '[{"id":"other"}]', "[]"),
        (5, "r", 40, "[]", None),
        (6, "r", 50, '[{"id":"a","n":"1","t":"x"},{"id":"c"}]', "[]"),
        (7, "s", 5, "[]", "[]"),
        (8, None, 5, "[]", "[]"),
    ]
    assert changes(spark, rows) == [("r", 30, "edge", "e", "changed"), ("r", 30, "entity", "b", "removed"), ("r", 30, "entity", "c", "added"), ("r", 50, "edge", "e", "removed"), ("r", 50, "entity", "a", "changed")]


def test_snapshot_empty(spark):
    assert changes(spark, []) == []


def test_canonical_records():
    p = snapshot_diff.parse_records
    assert p('[{"id":"a","x":1e2}]') == p('[{"x":100,"id":"a"}]') == p('[{"x":100.0,"id":"a","y":null}]')
    assert p('[{"id":"a","x":true}]') != p('[{"id":"a","x":1}]')
    assert p("[NaN]") is None and p("") is None and p(None) is None and p("null") == [] and p('[1,{"x":2}]') == []


def brute_rolling(rows, w):
    best = {}
    for e in rows:
        k = e[0] if e[0] is not None else object()
        if k not in best or best[k][5] < e[5]:
            best[k] = e
    by = {}
    for _, ts, prov, cost, tok, _ in best.values():
        ts = ts * 1000 if abs(ts) < 1e11 else ts
        by.setdefault((prov or "").strip().lower() or "(none)", []).append((ts // 86400000, cost, tok))
    out = {}
    for p, es in by.items():
        days = [d for d, _, _ in es]
        for d in range(min(days), max(days) + 1):
            hit = [e for e in es if d - w < e[0] <= d]
            out[p, d] = (round(sum(e[1] or 0 for e in hit), 6), sum(e[2] or 0 for e in hit), len(hit))
    return out


def test_rolling_against_brute_force(spark):
    rnd = random.Random(3)
    t = dt.datetime(2025, 1, 1)
    rows = [(i if i % 17 else None, 1_740_000_000_000 + rnd.randrange(200) * 86_400_000 // (1 if i % 3 else 7), rnd.choice(["A", " a", "b", None, ""]), rnd.choice([None, round(rnd.random(), 6)]), rnd.choice([None, rnd.randrange(1000)]), t) for i in range(400)]
    rows += [(1, rows[1][1], "late", 5.0, 7, t + dt.timedelta(days=1)), (9999, 1_740_000_000, "a", 1.0, 1, t)]
    df = spark.createDataFrame(rows, "entry_id long, timestamp long, provider string, estimated_cost double, input_tokens long, received_at timestamp")
    got = {(r["provider"], (r["day"] - dt.date(1970, 1, 1)).days): r for r in rolling.rolling_costs(df).collect()}
    for w in (7, 30):
        want = brute_rolling(rows, w)
        assert {k: (round(r[f"cost_sum_{w}"], 6), r[f"tokens_sum_{w}"], r[f"calls_{w}"]) for k, r in got.items()} == want


def test_rolling_empty(spark):
    df = spark.createDataFrame([], "entry_id long, timestamp long, provider string, estimated_cost double, input_tokens long, received_at timestamp")
    assert rolling.rolling_costs(df).count() == 0


def test_tree_correction(spark):
    schema = "entity string, day long, cost_sum decimal(38,9), cost_n long, tokens_sum long, tokens_n long, calls long"
    from decimal import Decimal as D

    a = spark.createDataFrame([("p", d, D(d % 5), 1, d, 1, 1) for d in range(100, 200)], schema)
    b = spark.createDataFrame([("p", 150, D(7), 1, 3, 1, 1), ("q", 120, D(1), 1, 1, 1, 1)], schema)
    fixed = rolling.correct_tree(rolling.build_tree(a), b)
    again = rolling.build_tree(a.unionByName(b).groupBy("entity", "day").agg(*rolling._sum_measures()))
    assert sorted(map(tuple, fixed.collect())) == sorted(map(tuple, again.select(fixed.columns).collect()))


def test_window_cover_is_exact(spark):
    df = spark.createDataFrame([(a, a + n) for a in range(60, 70) for n in (0, 1, 6, 29, 100)], "lo long, hi long")
    for lo, hi, cover in df.select("lo", "hi", rolling.window_cover("lo", "hi").alias("c")).collect():
        days = [d for c in cover for d in range(c["idx"] << c["level"], (c["idx"] + 1) << c["level"])]
        assert sorted(days) == list(range(lo, hi + 1))


def test_components(spark):
    rnd = random.Random(5)
    e = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(7, None), (5, 5), (1000, 1000)]
    out = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(e, "src long, dst long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in e:
        root(a)
        if b is not None:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    assert out == {x: root(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_entry_point(spark, sf):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    rows = e.queries()["p3_found"](spark, sf)
    assert rows.columns == ["repo_hash", "timestamp", "record_kind", "record_id", "change"]
    assert json.dumps(rows.schema.jsonValue())
