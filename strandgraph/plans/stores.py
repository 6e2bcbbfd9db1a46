"""The registered queries over sources and sinks: each writes, reads back and tells what it found; and the same as SQL."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import present, text
from ..functions.predicates import is_synthetic, project_matches
from ..graph import Graph
from ..operators import compare, resolve, structure
from ..sources import document, logs
from ..tables import scratch, written
from . import projection as P
from . import sql as S
from .queries import _CHANGES, _DIRTY, _SHOWN, _VIEW, SPLIT, _found, _register, _drawn_sql


def _put(spark, path: str, lines: list[str]) -> None:
    """A small text file of any file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray("\n".join(lines).encode()))
    out.close()


# Documents and snapshots

_KINDS = "kind IN ('type', 'interface')"


def _document(spark, sf) -> Graph:
    """The types and interfaces and what holds between them, written as one graph document and read again. A document is one object, and so one row."""
    g = P.index(spark, sf)
    nodes = g.nodes.where(_KINDS)
    ids = nodes.select("id")
    edges = g.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    role = F.when(F.col("role").isNotNull(), F.concat_ws(", ", F.when(F.col("role").bitwiseAND(1) != 0, "Read"), F.when(F.col("role").bitwiseAND(2) != 0, "Write"), F.when(F.col("role").bitwiseAND(4) != 0, "Subscribe")))
    n = nodes.agg(F.sort_array(F.collect_list(F.struct("id", "key", "name", "short", "kind", "file", "line", "end_line", "signature", "project", "tags"))).alias("nodes"))
    e = edges.agg(F.sort_array(F.collect_list(F.struct("ord", F.struct(F.col("src").alias("from"), F.col("dst").alias("to"), "kind", "note", "confidence", "source", "site", role.alias("role")).alias("e")))).alias("edges"))
    u = g.unresolved.groupBy("reason").agg(F.count(F.lit(1)).cast("int").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("reason", "n"))).alias("unresolved_by_reason"))
    doc = n.crossJoin(e).crossJoin(u).select(F.lit(document.FORMAT).alias("format_version"), F.lit("abc1234").alias("built_from_commit"), "nodes", F.transform("edges", lambda x: x["e"]).alias("edges"), "unresolved_by_reason")
    path = scratch(spark)
    doc.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    return document.load(spark, path)


@_register(f"WITH {S.NODES} SELECT id, key, name, kind, file, line, end_line, project, array_to_string(tags, ',') AS tags FROM nodes WHERE {_KINDS}")
def document_nodes(spark, sf):
    return _document(spark, sf).nodes.select("id", "key", "name", "kind", "file", "line", "end_line", "project", F.array_join("tags", ",").alias("tags"))


@_register(f"WITH {S.GRAPH}, t AS (SELECT id FROM nodes WHERE {_KINDS}) SELECT src, dst, kind, note, confidence, source, site FROM edges WHERE src IN (SELECT id FROM t) AND dst IN (SELECT id FROM t)")
def document_edges(spark, sf):
    return _document(spark, sf).edges.select("src", "dst", "kind", "note", "confidence", "source", "site")


def _sizes(name: str, g: Graph):
    out = None
    for t in document.TABLES:
        if (df := getattr(g, t)) is not None:
            row = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("snapshot"), F.lit(t).alias("part"), "rows")
            out = row if out is None else out.unionByName(row)
    return out


@_register(
    f"WITH {S.NODES}, {S.edges('e0', f'l_shipdate < TIMESTAMP {chr(39)}{SPLIT}{chr(39)}')}, {S.edges('e1')}, {S.UNRESOLVED}, n AS (SELECT count(*) AS n FROM nodes), a AS (SELECT count(*) AS n FROM e0), b AS (SELECT count(*) AS n FROM e1), u AS (SELECT count(*) AS n FROM sites), r AS (SELECT count(*) AS n FROM nation) "
    "SELECT s AS snapshot, p AS part, n AS rows FROM (SELECT 'base' AS s, 'nodes' AS p, n FROM n UNION ALL SELECT 'base', 'edges', n FROM a UNION ALL SELECT 'previous', 'nodes', n FROM n UNION ALL SELECT 'previous', 'edges', n FROM a "
    "UNION ALL SELECT 'current', 'nodes', n FROM n UNION ALL SELECT 'current', 'edges', n FROM b UNION ALL SELECT 'current', 'unresolved', n FROM u UNION ALL SELECT 'current', 'files', n FROM r UNION ALL SELECT 'current', 'meta', 1)"
)
def snapshots(spark, sf):
    """The earlier state and the present one saved, the latter with all side tables and then again in place, and read as base, previous and current."""
    g, before = P.index(spark, sf), P.index(spark, sf, SPLIT)
    files = P._places(spark, sf).select(F.col("n_file").alias("path"), F.lit(0).cast("long").alias("ticks"), F.length("n_file").cast("long").alias("size"), F.lit("").alias("hash"))
    meta = spark.createDataFrame([("abc1234",)], "built_from_commit string")
    store = document.Snapshots(spark, scratch(spark))
    whole = Graph(g.nodes, g.edges, files=files, unresolved=g.unresolved, meta=meta)
    store.save(before)
    store.save(whole)
    store.save(whole, rotate=False)
    store.save_base(before, "abc1234", "r1")
    return _sizes("current", store.load()).unionByName(_sizes("previous", store.load(previous=True))).unionByName(_sizes("base", store.load(store.base("abc1234", "r1"))))


@_register("SELECT * FROM (VALUES ('base-c0-r1', FALSE), ('base-c1-r1', FALSE), ('base-c2-r1', FALSE), ('base-c2-r2', TRUE), ('base-c3-r1', TRUE)) t(name, stays)")
def snapshots_pruned(spark, sf):
    """Of five base snapshots, the two newest but those of a commit with other references."""
    regions = Graph(*(df.limit(0) for df in (P.index(spark, sf).nodes, P.index(spark, sf).edges)))
    store = document.Snapshots(spark, scratch(spark))
    names = [store.save_base(regions, c, r) for c, r in (("c0", "r1"), ("c1", "r1"), ("c2", "r1"), ("c2", "r2"), ("c3", "r1"))]
    gone = store.prune("c2", "r2", keep=2)
    return spark.createDataFrame([(n, n not in gone) for n in names], "name string, stays boolean")


@_register("SELECT substr(sha256(string_agg(line, chr(10) ORDER BY line)), 1, 12) AS key FROM (SELECT s_name || '|' || s_suppkey || '|' || (s_nationkey * 1000) AS line FROM supplier)")
def reference_key(spark, sf):
    refs = P.table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").cast("long").alias("size"), (F.col("s_nationkey") * 1000).cast("long").alias("ticks"))
    return spark.createDataFrame([(document.reference_key(refs),)], "key string")


@_register(
    "SELECT 'd' || (c_custkey % 9) || '/' || c_name || '.cs' AS path, CASE WHEN c_custkey % 7 = 0 THEN 'missing' WHEN c_custkey % 7 = 1 THEN 'size' WHEN c_custkey % 7 = 2 THEN 'time' WHEN c_custkey % 7 = 3 THEN 'content' END AS why FROM customer WHERE c_custkey % 7 < 4 "
    "UNION ALL SELECT 'd' || (s_suppkey % 9) || '/' || s_name || '.cs', 'new' FROM supplier WHERE s_suppkey % 9 < 4"
)
def dirty_files(spark, sf):
    """Customers as the stamps of files: by their key, some are gone, resized, touched later, changed within the tolerance, or the same; suppliers as new files, of which those in directories that moved are seen."""
    k = F.col("c_custkey")
    path = F.concat(F.lit("d"), (k % 9).cast("string"), F.lit("/"), "c_name", F.lit(".cs"))
    stamps = P.table(spark, sf, "customer").select(path.alias("path"), F.lit(1000).cast("long").alias("ticks"), k.cast("long").alias("size"), F.lit("h").alias("hash"), k.alias("k"))
    late = F.when(F.col("k") % 7 == 2, 900_000_000).when(F.col("k") % 7 >= 3, 2000).otherwise(1000).cast("long")
    seen = stamps.where("k % 7 <> 0").select("path", late.alias("ticks"), F.when(F.col("k") % 7 == 1, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(F.col("k") % 7 == 3, "i").otherwise("h").alias("hash"))
    new = P.table(spark, sf, "supplier").select(F.concat(F.lit("d"), (F.col("s_suppkey") % 9).cast("string"), F.lit("/"), "s_name", F.lit(".cs")).alias("path"), F.lit(1).cast("long").alias("ticks"), F.lit(1).cast("long").alias("size"), F.lit("").alias("hash"))
    moved = spark.createDataFrame([(f"d{k}",) for k in range(4)], "path string")
    return document.dirty_files(stamps.drop("k"), seen.unionByName(new), moved)


@_register("SELECT n_name || '/a.cs' AS path, CAST(length(n_name) AS BIGINT) AS size FROM nation WHERE n_nationkey % 5 <> 1")
def listing(spark, sf):
    """A source for each nation, below folders of which every fifth is left out, in any case of letters."""
    root = scratch(spark)
    left_out = ["bin", "OBJ", "Artifacts", ".git", "node_modules"]
    for r in P.table(spark, sf, "nation").select("n_nationkey", "n_name").collect():  # as many as there are nations
        k, name = r["n_nationkey"], r["n_name"]
        _put(spark, f"{root}/{name}/a.cs" if k % 5 != 1 else f"{root}/{name}/{left_out[k // 5 % 5]}/a.cs", [name])
        _put(spark, f"{root}/{name}/a.Designer.cs", ["x"])
    return document.listing(spark, root).select("path", "size")


# Logs, baselines, diffs and answers


@_register(f"WITH {S.LOG} SELECT cmd, exit, count(*) AS runs, CAST(sum(ms) AS BIGINT) AS ms, count(DISTINCT session) AS sessions, min(ts) AS first FROM log GROUP BY cmd, exit")
def usage_written(spark, sf):
    """All invocations appended to a log of JSON lines in two goes, and read again."""
    path, rows = scratch(spark), P.usage_log(spark, sf)
    for part in ("exit = 0", "exit <> 0"):
        logs.append_usage(rows.where(part), path)
    got = logs.read_usage(spark, path)
    return got.groupBy("cmd", F.col("exit")).agg(F.count(F.lit(1)).alias("runs"), F.sum("ms").alias("ms"), F.count_distinct("session").alias("sessions"), F.min("ts").cast("timestamp_ntz").alias("first"))


@_register(f"{_CHANGES} SELECT id, relation FROM ch WHERE relation <> 'removed'")
def baseline_gate(spark, sf):
    """All removals accepted in a baseline file, and what a gate has left."""
    found, path = written(_found(spark, sf)), scratch(spark)
    logs.write_baseline(found.where("relation = 'removed'").select("id", F.concat_ws(" ", "kind", "from_key", "to_key").alias("text")), path)
    return compare.unaccepted(found, logs.accepted(spark, path)).select("id", "relation")


@_register("SELECT * FROM (VALUES ('a/Directory.Packages.props'), ('src/x.csproj'), ('global.json')) t(path)")
def reference_inputs(spark, sf):
    names = ["a\\Directory.Packages.props", "src/x.csproj", "global.json", "src/x.cs", "readme.md", "global.json.bak"]
    return compare.reference_inputs(spark.createDataFrame([(x,) for x in names], "path string"))


@_register("SELECT 0 AS status, row_number() OVER (ORDER BY r_name) AS place, r_name AS name, (SELECT count(*) FROM region) > 3 AS truncated FROM region ORDER BY r_name LIMIT 3")
def answer_envelope(spark, sf):
    """The first three regions by name as one JSON object, taken apart."""
    got = json.loads(logs.envelope(P.table(spark, sf, "region").select("r_name").orderBy("r_name"), 0, most=3))
    return spark.createDataFrame([(got["exit"], k + 1, r["r_name"], got["truncated"]) for k, r in enumerate(got["rows"])], "status int, place long, name string, truncated boolean")


@_register(f"SELECT line FROM ({_drawn_sql('dot')})")
def diagram_written(spark, sf):
    """The diagram of projects in a file below a folder, as lines."""
    g, root = P.index(spark, sf), scratch(spark)
    _put(spark, f"{root}/here", [])
    view = written(structure.exported(g, "project"))
    logs.write_diagram(structure.diagram(view, "dot"), root, "projects.dot", view, structure.withheld(g, "project"))
    return spark.read.text(f"{root}/projects.dot").withColumnRenamed("value", "line")


# Predicates and the rows of answers


@_register(f"WITH {S.NODES}, {_DIRTY} SELECT short AS symbol, kind, CASE WHEN file <> '' THEN file END AS file, line, greatest(end_line, line) AS end_line, file <> '' AND file IN (SELECT file FROM dirty) AS stale, id, CASE WHEN len(tags) > 0 THEN array_to_string(tags, ',') END AS tags FROM nodes")
def answer_rows(spark, sf):
    """All nodes as the rows of an answer, with the files of three places changed."""
    dirty = P._places(spark, sf).where("n_nationkey < 3").select(F.col("n_file").alias("file"))
    return present.answer(P.index(spark, sf).nodes, dirty).select("symbol", "kind", "file", "line", "end_line", "stale", "id", F.array_join("tags", ",").alias("tags"))


@_register(
    f"WITH {S.PLACE}, {S.edges()}, w AS (SELECT src, dst, kind, CASE WHEN kind = 'Mediatr' THEN 'mediatr ' || note WHEN kind = 'Interface' THEN 'impl' || CASE WHEN note = 'di-bound' THEN ', di-bound' ELSE '' END WHEN kind = 'Construct' THEN 'new' WHEN kind = 'DiBinding' THEN 'di:' || note ELSE '' END AS word, "
    "CASE WHEN score < 1 THEN concat_ws(' ', '?' || printf('%.2f', score), source) ELSE '' END AS doubt FROM edges) SELECT src, dst, kind, CASE WHEN word = '' AND doubt = '' THEN '' ELSE '[' || word || CASE WHEN word <> '' AND doubt <> '' THEN ' ' ELSE '' END || doubt || ']' END AS mark FROM w"
)
def answer_marks(spark, sf):
    return P.index(spark, sf).edges.select("src", "dst", "kind", present.mark().alias("mark"))


@_register(f"WITH {S.NODES} SELECT id, contains(n, '<anonymous') OR starts_with(n, '(') AS synthetic, contains(p, '/') AND split_part(lower(p), '/', -1) = 'asia' OR lower(p) = 'asia' AS asia FROM (SELECT id, CASE id % 3 WHEN 0 THEN '<anonymous ' || name || '>' WHEN 1 THEN '(' || name || ')' ELSE name END AS n, CASE id % 2 WHEN 0 THEN 'src/' || project ELSE project END AS p FROM nodes)")
def synthetic_and_projects(spark, sf):
    """Every node under a name that may be one a compiler makes, and in a project that may stand in a folder."""
    name = F.when(F.col("id") % 3 == 0, F.concat(F.lit("<anonymous "), "name", F.lit(">"))).when(F.col("id") % 3 == 1, F.concat(F.lit("("), "name", F.lit(")"))).otherwise(F.col("name"))
    project = F.when(F.col("id") % 2 == 0, F.concat(F.lit("src/"), "project")).otherwise(F.col("project"))
    rows = P.index(spark, sf).nodes.select("id", name.alias("name"), project.alias("project"))
    return rows.select("id", is_synthetic().alias("synthetic"), project_matches("project", "ASIA").alias("asia"))


@_register("SELECT event_id, replace(props, '\"', '#quot;') AS mermaid, replace(replace(props, '\\', '\\\\'), '\"', '\\\"') AS dot FROM events")
def escapes(spark, sf):
    return P.table(spark, sf, "events").select("event_id", text.mermaid(F.col("props")).alias("mermaid"), text.dot(F.col("props")).alias("dot"))


@_register("SELECT * FROM (VALUES ('AFRICA.NATION_5', 1), ('no such thing', 0), ('NATION_5()', 1)) t(q, nodes)")
def resolve_single(spark, sf):
    """A name, a selector with parameters, and a name that nothing has."""
    g, out = P.index(spark, sf), []
    for q in ("AFRICA.NATION_5", "no such thing", "NATION_5()"):
        try:
            resolve.single(g, q)
            out.append((q, 1))
        except resolve.NotFound:
            out.append((q, 0))
    return spark.createDataFrame(out, "q string, nodes int")
