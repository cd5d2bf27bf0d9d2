"""Files, snapshots, exports and streams on temporary folders."""

from pyspark.sql import functions as F

from chronoloom.sources import files, snapshots, tables
from chronoloom.streaming import sessions


def test_ignore_rules(spark):
    paths = ["a.log", "keep.log", "build/x.ts", "src/build/y.ts", "src/a.ts", "docs/deep/n.md", "root.txt", "src/root.txt"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    left = {r.path for r in df.where(files.not_ignored(F.col("path"), ["# c", "", "*.log", "!keep.log", "build/", "docs/**/n.md", "/root.txt"])).collect()}
    assert left == {"keep.log", "src/a.ts", "src/root.txt"}


def test_repository_scan(spark, tmp_path):
    for p, t in {"src/a.ts": "export function f() {}", "node_modules/x.ts": "no", "README.md": "# Hi\ntext", "b.bin": "z"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    got = {r.path: r.text for r in files.scan_repository(spark, str(tmp_path), endings=["ts", "md"]).collect()}
    assert got == {"src/a.ts": "export function f() {}", "README.md": "# Hi\ntext"}
    found = {r.path: r.priority for r in files.discover_documents(spark.createDataFrame([("README.md",), ("docs/x.md",), ("src/a.ts",), ("node_modules/README.md",)], "path string")).collect()}
    assert found == {"README.md": 4, "docs/x.md": 5}


def test_markdown(spark):
    f = spark.createDataFrame([("a.md", "---\nname: Alpha\n---\n# Alpha\nsee [[Beta]]\n- solves: [[Beta]]\n"), ("b.md", "---\ntitle: Beta\n---\n## Part\nx")], "path string, text string")
    nodes, edges = files.import_vault(f)
    assert {r.name for r in nodes.collect()} == {"Alpha", "Beta"}
    assert {(r.from_id, r.to_id, r.type) for r in edges.collect()} == {("a.md", "b.md", "relates_to"), ("a.md", "b.md", "solves")}
    n, e = files.ingest_markdown(f)
    assert n.where("type = 'FileNode'").count() == 2 and e.count() == n.where("type = 'ContentChunk'").count()
    assert n.select("id").exceptAll(files.ingest_markdown(f)[0].select("id")).count() == 0


def test_vault_round_trip(spark, sf):
    n, e = tables.nodes(spark, sf), tables.edges(spark, sf)
    notes = files.vault_notes(n, e)
    back, _ = files.import_vault(notes)
    active = n.where("t_valid_until is null and archived_at is null")
    assert back.select("name", "type").exceptAll(active.select("name", "type")).count() == 0 and notes.count() == active.count()


def test_transcript_and_manifests(spark):
    lines = spark.createDataFrame([("t", i, '{"role":"user","text":"%d"}' % i if i % 3 else "broken {") for i in range(1, 251)], "path string, line_no long, value string")
    tail = files.transcript_tail(lines, "role string, text string").collect()
    assert len(tail) == sum(1 for i in range(151, 251) if i % 3) and min(r.line_no for r in tail) >= 151
    m = spark.createDataFrame([("Cargo.toml", '[workspace]\nmembers = ["a", "b"]'), ("x/go.mod", "replace foo => ../foo"), ("p/package.json", '{"workspaces": ["pkgs/*"]}'), ("s.c", '#include "s.h"\n#include <stdio.h>')], "path string, text string")
    assert {(r.kind, r.target) for r in files.manifest_links(m).collect()} == {("cargo_member", "a"), ("cargo_member", "b"), ("go_replace", "../foo"), ("workspace", "pkgs/*"), ("include", "s.h")}
    c = spark.createDataFrame([("api.yaml", "openapi: 3.0"), ("x.proto", ""), ("y.yaml", "a: 1")], "path string, text string")
    assert {(r.path, r.format) for r in files.api_contracts(c).collect()} == {("api.yaml", "openapi"), ("x.proto", "grpc")}


def test_snapshots(spark, sf, tmp_path):
    root = str(tmp_path / "snap")
    n = tables.nodes(spark, sf).select("id", "name")
    assert snapshots.nearest_snapshot(spark, root, 5) is None and snapshots.restore_snapshot(spark, root, 5) == {}
    snapshots.write_snapshot(root, 10, nodes=n)
    snapshots.write_snapshot(root, 20, nodes=n.limit(3))
    assert snapshots.list_snapshots(spark, root) == [10, 20] and snapshots.nearest_snapshot(spark, root, 19) == 10
    assert snapshots.restore_snapshot(spark, root, 15)["nodes"].exceptAll(n).count() == 0
    b = str(tmp_path / "branches")
    snapshots.write_branch(n, b, "main")
    snapshots.write_branch(n.limit(1), b, "dev")
    snapshots.write_branch(n.limit(2), b, "dev")
    assert snapshots.read_branch(spark, b, "dev").count() == 2 and snapshots.read_branch(spark, b, "main").count() == n.count()


def test_export_import(spark, sf, tmp_path):
    n, e, c = tables.nodes(spark, sf), tables.edges(spark, sf), tables.table(spark, sf, "communities")
    snapshots.export_graph(n, e, c, str(tmp_path))
    back = snapshots.read_export(spark, str(tmp_path), {"nodes": n, "edges": e, "communities": c})
    active = n.where("t_valid_until is null and archived_at is null")
    assert back["nodes"].select("id", "name", "tags").exceptAll(active.select("id", "name", "tags")).count() == 0
    slim = n.drop("embedding", "embedding_code")
    nodes2, edges2 = snapshots.import_merge(slim, e, back["nodes"], back["edges"])
    assert nodes2.count() == slim.count() and edges2.count() == e.count()
    assert snapshots.import_replace(slim, back["nodes"].limit(0), 9).where("t_valid_until is null and archived_at is null").count() == 0
    merged, lost = snapshots.merge_repos({"a": slim.limit(2), "b": slim.limit(3), "c": None})
    assert merged.count() == 5 and lost == ["c"]


def test_streams_agree_with_batch(spark, sf, tmp_path):
    src, ev = str(tmp_path / "in"), tables.table(spark, sf, "hook_events")
    ev.orderBy("occurred_at").coalesce(1).write.parquet(src)
    stream = sessions.read_events(spark, src, ev.schema)
    once = ev.dropDuplicates(["event_id"])
    sessions.run_available(sessions.stream_throttle(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out"))
    from chronoloom.operators.retrieval import throttle

    want = throttle(once)
    assert got.groupBy("mode").count().exceptAll(want.groupBy("mode").count()).count() == 0
    sessions.run_available(sessions.stream_tool_counts(stream), str(tmp_path / "out2"), str(tmp_path / "cp2"))
    n = spark.read.parquet(str(tmp_path / "out2")).agg(F.sum("n")).first()[0]
    assert 0 < n <= once.where("tool_name is not null").count()
    sessions.run_available(sessions.stream_sessions(stream), str(tmp_path / "out3"), str(tmp_path / "cp3"))
    assert spark.read.parquet(str(tmp_path / "out3")).count() > 0


def test_drift_and_kinds(spark):
    h = spark.createDataFrame([("s", i, "discomfort" if i % 2 else "other", 1.0 if i > 5 else 0.0, i) for i in range(30)], "session_id string, event_id long, event_type string, score double, created_at long")
    assert [tuple(r) for r in sessions.drift(h).collect()] == [("s", 1.0, "block")]
    assert sessions.drift(h.limit(0)).count() == 0
    s = spark.createDataFrame([("s", "k", float(i), i) for i in range(3)] + [("s", "few", 1.0, 1)], "session_id string, kind string, intensity double, at long")
    assert [tuple(r) for r in sessions.signal_rollup(s).collect()] == [("s", "k", 3, 2.0, 2)]
