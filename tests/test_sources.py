import json
import os
import time

import pytest
from pyspark.sql import functions as F

from strandgraph.functions import text
from strandgraph.operators import structure
from strandgraph.sources import document, logs
from strandgraph.streaming import usage


def write(path, value):
    path.write_text(json.dumps(value))
    return str(path)


def doc(**more):
    nodes = [{"id": 1, "key": "k1", "name": "N.A", "short": "A", "kind": "type", "file": "a.cs", "line": 3, "end_line": 9, "tags": ["handler"]}, {"id": 2, "key": "k2", "name": "N.A.m", "short": "A.m", "kind": "method", "file": "a.cs", "line": 4}]
    edges = [{"from": 1, "to": 2, "kind": "TypeUse", "note": "member"}, {"from": 2, "to": 1, "kind": "Call", "confidence": 0.7, "role": "Read, Write"}, {"from": 2, "to": 9, "kind": "Call"}]
    return {"format_version": 15, "nodes": nodes, "edges": edges, "project_references": {"p": ["q", "r"]}, "handlers_by_request": {"R": [2]}, "built_from_commit": "abc", **more}


def test_load(spark, tmp_path):
    g = document.load(spark, write(tmp_path / "g.json", doc()))
    assert [(r["src"], r["dst"], r["role"], r["ord"]) for r in g.edges.orderBy("ord").collect()] == [(1, 2, None, 0), (2, 1, 3, 1)]
    assert [(r["id"], r["end_line"], r["tags"]) for r in g.nodes.orderBy("id").collect()] == [(1, 9, ["handler"]), (2, 4, [])]
    assert g.project_refs.count() == 2 and g.meta.first()["built_from_commit"] == "abc" and g.unresolved.count() == 0


def test_refusals(spark, tmp_path):
    with pytest.raises(document.MissingGraph):
        document.load(spark, str(tmp_path / "none.json"))
    with pytest.raises(document.WrongFormat):
        document.load(spark, write(tmp_path / "old.json", doc(format_version=3)))
    (tmp_path / "bad.json").write_text("{nonsense")
    with pytest.raises(document.UnreadableGraph):
        document.load(spark, str(tmp_path / "bad.json"))


def test_snapshots(spark, tmp_path):
    g = document.load(spark, write(tmp_path / "g.json", doc()))
    store = document.Snapshots(spark, str(tmp_path / "store"))
    with pytest.raises(document.MissingGraph):
        store.load()
    first = store.save(g)
    second = store.save(g)
    assert store.load().nodes.count() == 2 and store.pointer()[1:] == (second, first)
    third = store.save(g, rotate=False)
    assert store.pointer()[1:] == (third, first) and store.load(previous=True).edges.count() == 2
    got = store.load()
    assert got.meta.first()["built_from_commit"] == "abc" and got.project_refs.count() == 2 and got.handlers.count() == 1 and got.files.count() == 0
    for n in range(3):
        store.save_base(g, f"c{n}", "r1")
        time.sleep(0.05)
    store.save_base(g, "c2", "r2")
    gone = store.prune("c2", "r2", keep=2, older=0)
    assert "base-c2-r1" in gone and second in gone and not {first, third} & set(gone)
    assert store.load(store.base("c2", "r2")).edges.count() == 2


def test_a_writer_that_fails_or_is_late_changes_nothing(spark, tmp_path):
    g = document.load(spark, write(tmp_path / "g.json", doc()))
    store = document.Snapshots(spark, str(tmp_path / "store"))
    first = store.save(g)
    (tmp_path / "store" / "pointer-000000000002").write_text("half")  # a crash while a pointer is made
    assert store.pointer()[1] == first and store.load().nodes.count() == 2
    second = store.save(g)
    assert store.pointer() == (3, second, first)
    late = document.Snapshots(spark, str(tmp_path / "store"))
    late._names = lambda start: [("pointer-000000000002", 0)] if start == "pointer-" else []  # sees no later pointer
    with pytest.raises(document.Contended):
        late._point("other", True, False)
    assert store.pointer()[1] == second


def test_reference_key(spark):
    refs = spark.createDataFrame([("b", 2, 20), ("a", 1, 10)], "name string, size long, ticks long")
    import hashlib

    assert document.reference_key(refs) == hashlib.sha256(b"a|1|10\nb|2|20").hexdigest()[:12]


def test_dirty(spark):
    kind = "path string, ticks long, size long, hash string"
    a = spark.createDataFrame([("d/same", 5, 1, "h"), ("d/gone", 5, 1, "h"), ("d/size", 5, 1, "h"), ("d/late", 5, 1, "h"), ("d/touch", 5, 1, "h"), ("d/edit", 5, 1, "h")], kind)
    b = spark.createDataFrame([("d/same", 5, 1, None), ("d/size", 5, 2, "h"), ("d/late", 30_000_000, 1, "h"), ("d/touch", 900, 1, "h"), ("d/edit", 900, 1, "i"), ("e/new", 1, 1, "h"), ("f/new", 1, 1, "h")], kind)
    moved = spark.createDataFrame([("e",)], "path string")
    assert {tuple(r) for r in document.dirty_files(a, b, moved).collect()} == {("d/gone", "missing"), ("d/size", "size"), ("d/late", "time"), ("d/edit", "content"), ("e/new", "new")}
    assert document.dirty_files(a, b).count() == 6


def test_listing(spark, tmp_path):
    for name in ("src/a.cs", "src/obj/b.cs", "src/Artifacts/x.cs", "BIN/y.cs", "src/c.g.cs", ".git/d.cs", "e.txt"):
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_text("x")
    assert [r["path"] for r in document.listing(spark, str(tmp_path), content=True).collect()] == ["src/a.cs"]


LINES = ['{"schema_version":2,"ts":"2024-01-01T10:00:00Z","cmd":"trace","exit":0,"ms":5,"caller":"a","tty":true}', '{"Ts":"2024-01-01T10:05:00Z","Cmd":"impl","Exit":2,"Ms":7,"OutTokens":9,"Caller":"a"}', "not json", "{}", '{"ts":"2024-01-01T14:00:00Z","cmd":"trace","exit":0,"ms":"x"}']


def test_usage(spark, tmp_path):
    (tmp_path / "usage.jsonl").write_text("\n".join(LINES))
    rows = logs.read_usage(spark, str(tmp_path)).orderBy("ts").collect()
    assert [(r["cmd"], r["exit"], r["ms"], r["out_tokens"]) for r in rows] == [("trace", 0, 5, None), ("impl", 2, 7, 9), ("trace", 0, None, None)]


def test_usage_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/usage.jsonl").write_text("\n".join(LINES))
    rows = logs.stream_usage(spark, str(tmp_path / "in"))
    asked = {"windows": (usage.windows(rows), "complete", 3), "sessions": (usage.sessions(rows.where("caller IS NOT NULL"), "10 minutes"), "append", 0)}
    for name, (df, mode, want) in asked.items():  # in append mode the last session is still open
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        assert spark.table(name).count() == want


def test_baseline(spark, tmp_path):
    found = spark.createDataFrame([("aa", "x y\nz"), ("bb", "q")], "id string, text string")
    path = str(tmp_path / "accepted")
    assert logs.write_baseline(found, path) == 0
    got = logs.read_baseline(spark, path)
    assert sorted(tuple(r) for r in got.collect()) == [("aa", "x y z"), ("bb", "q")]
    assert logs.write_baseline(found.where("id = 'aa'"), str(tmp_path / "next"), got) == 1
    assert logs.baseline_format(spark, path) == document.FORMAT and logs.accepted(spark, path).count() == 2
    assert logs.accepted(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "old").write_text("aa x\n")
    with pytest.raises(document.WrongFormat):
        logs.accepted(spark, str(tmp_path / "old"))


def test_diagrams_stay_below_their_folder(spark, tmp_path):
    root = tmp_path / "root"
    root.mkdir()
    for path in ("../x.dot", "/etc/x.dot", "a/../../x.dot", "none/x.dot"):
        with pytest.raises(logs.OutsideRoot):
            logs.confined(spark, str(root), path)
    view = spark.createDataFrame([("a", "b", "Call", 2, 1.0, 3)], "a string, b string, kind string, role long, score double, edges long")
    out = spark.createDataFrame([(2, 1, 0, 4, 1)], "type_use long, tests long, synthetic long, within long, drawn long")
    for _ in range(2):
        said = logs.write_diagram(structure.diagram(view), str(root), "x.mmd", view, out)
    assert said == ["x.mmd: nodes: 2, edges: 1", "withheld: test code 1 edge(s); type use 2 edge(s); within a group 4 edge(s)"]
    assert [r["value"] for r in spark.read.text(str(root / "x.mmd")).collect()][0] == "flowchart LR" and len(os.listdir(root)) == 1


def test_no_shared_folder_on_a_cluster(spark, monkeypatch):
    from strandgraph import tables

    class Cluster:
        sparkContext = type("C", (), {"master": "spark://host:7077", "getConf": staticmethod(lambda: {})})
        conf = type("F", (), {"get": staticmethod(lambda *a: None)})

    with pytest.raises(RuntimeError):
        tables.shared_dir(Cluster)


def test_envelope(spark):
    got = json.loads(logs.envelope(spark.range(5), 0, most=3))
    assert got == {"exit": 0, "rows": [{"id": 0}, {"id": 1}, {"id": 2}], "truncated": True}


def test_diagrams(spark):
    view = spark.createDataFrame([("a", 'b"', "Call", 2, 1.0, 3), ("a", "c", "Mediatr", 0, 0.7, 1)], "a string, b string, kind string, role long, score double, edges long")
    art = list(structure.lines(structure.diagram(view)))
    assert art[0] == "flowchart LR" and any("#quot;" in x for x in art) and sum(".->" in x for x in art) == 2 and any("Mediatr ?0.70" in x for x in art)
    graph = list(structure.lines(structure.diagram(view, "dot")))
    assert graph[0] == "digraph G {" and graph[-1] == "}" and any('b\\"' in x for x in graph)


def test_text(spark):
    words = {"DeleteAsync": ["delete", "async"], "HTTPServer_name": ["http", "server", "name"], "a.b": ["a.b"], "x": ["x"], "v2Api": ["v2", "api"]}
    df = spark.createDataFrame([(k,) for k in words], "t string")
    assert {r["t"]: r["w"] for r in df.select("t", text.identifier_tokens(F.col("t")).alias("w")).collect()} == words
    kinds = {"TODO x": "comment", "/orders": "route", "api/x": "route", "a/b": "route", "MY_VAR": "environment-variable", "a/b.json": "file", "A:B": "configuration-key", "Jwt.Key": "configuration-key", "Lib": "package", "how does it": "prose", "Foo.Bar": "symbol", "src/a.cs": "symbol"}
    df = spark.createDataFrame([(k,) for k in kinds], "t string")
    got = {r["t"]: r["k"] for r in df.select("t", text.question_kind(F.col("t"), F.array(F.lit("lib.core"))).alias("k")).collect()}
    assert {k: v["kind"] for k, v in got.items()} == kinds
    assert got["A:B"]["decisive"] and not got["Jwt.Key"]["decisive"] and not got["Lib"]["decisive"]
