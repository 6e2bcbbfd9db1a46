"""The registered queries: every operator on the projected graph, and the same as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import TYPES, is_test, score, token_cost
from ..graph import Graph
from ..operators import bind, compare, explain, rank, resolve, structure, walk
from . import projection as P
from . import sql as S

#: Places that the queries ask about.
TARGET, START, GOAL, PARTNER = 2_000_000_015, 2_000_000_003, 2_000_000_011, 6_000_000_001
SPLIT = "1998-05-24"
QUESTIONS = ("NATION_7", "AFRICA.NATION_5", "Customer#000000012", "nation_1.customer#000000001", "Supplier#00000000", "ring.P10", "nothing here")
MISSPELT = ("NATION_3.Suplier#000000003", "Customr#000000012", "O1234", "Part_P77", "small.ring.P7")
TERMS = ("nation_7", "customer")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _asked(spark: SparkSession, names: tuple[str, ...]) -> DataFrame:
    return spark.createDataFrame([(x,) for x in names], "q string")


def _values(names: tuple[str, ...], column: str = "q") -> str:
    return "(VALUES " + ", ".join(f"('{x}')" for x in names) + f") t({column})"


# Projection and counts


@_register(f"WITH {S.NODES} SELECT id, key, name, short, kind, file, line, end_line, signature, project, array_to_string(tags, ',') AS tags FROM nodes")
def node_projection(spark, sf):
    return P.nodes(spark, sf).withColumn("tags", F.array_join("tags", ","))


@_register(f"WITH {S.PLACE}, {S.edges()} SELECT src, dst, kind, note, confidence, source, site, role FROM edges")
def edge_projection(spark, sf):
    return P.edges(spark, sf).drop("ord")


@_register("SELECT 5000000000 + l_orderkey AS src, 6000000000 + l_partkey AS dst, CAST(bit_or(CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 4 END) AS INTEGER) AS role, 'lineitem:' || coalesce(min(l_linenumber) FILTER (WHERE l_returnflag = 'R'), min(l_linenumber)) AS site FROM lineitem GROUP BY l_orderkey, l_partkey")
def role_merge(spark, sf):
    return P.merge_accesses(P.accesses(spark, sf)).select("src", "dst", "role", "site")


@_register(f"WITH {S.PLACE}, {S.edges()} SELECT kind, count(*) AS edges FROM edges WHERE {S.FLOW} GROUP BY kind")
def flow_edges(spark, sf):
    return rank.flow_counts(P.index(spark, sf))


@_register(f"WITH {S.NODES} SELECT id, short, project, array_to_string(tags, ',') AS tags FROM nodes WHERE {S.ENTRY}")
def entrypoints(spark, sf):
    return rank.entrypoints(P.index(spark, sf))


@_register(f"WITH {S.NODES} SELECT id, short, project, array_to_string(tags, ',') AS tags FROM nodes WHERE {S.ENTRY} AND starts_with(lower(file), 'africa/') AND (contains(lower(short), '7') OR len(list_filter(tags, lambda t: contains(lower(t), '7'))) > 0)")
def entrypoints_filtered(spark, sf):
    return rank.entrypoints(P.index(spark, sf), wanted="7", prefix="Africa\\")


@_register(f"WITH {S.NODES} SELECT project, count(*) AS tests FROM nodes WHERE {S.TEST} GROUP BY project")
def tests(spark, sf):
    return P.index(spark, sf).nodes.where(is_test()).groupBy("project").agg(F.count(F.lit(1)).alias("tests"))


@_register(f"WITH {S.GRAPH} SELECT (SELECT count(DISTINCT lower(file)) FROM nodes WHERE file <> '') AS files, (SELECT count(*) FROM nodes) AS symbols, (SELECT count(*) FROM edges) AS edges")
def map_header(spark, sf):
    return rank.map_header(P.index(spark, sf))


@_register(f"WITH {S.GRAPH}, n AS (SELECT * FROM nodes WHERE starts_with(lower(file), 'asia/')) SELECT (SELECT count(DISTINCT lower(file)) FROM n) AS files, (SELECT count(*) FROM n) AS symbols, (SELECT count(*) FROM edges WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)) AS edges")
def map_header_under(spark, sf):
    return rank.map_header(P.index(spark, sf), "ASIA/")


_DEPTH = f"{S.REFS}, chain AS (WITH RECURSIVE c AS (SELECT src AS root, dst AS low, 1 AS d FROM refs UNION SELECT root, dst, d + 1 FROM c JOIN refs ON src = low) SELECT root AS project, max(d) AS depth FROM c GROUP BY root)"


@_register(f"WITH {S.NODES}, {_DEPTH} SELECT r_name AS project, CAST(coalesce(depth, 0) AS BIGINT) AS depth FROM region LEFT JOIN chain ON r_name = project")
def project_depth(spark, sf):
    regions = P.table(spark, sf, "region").select(F.col("r_name").alias("project"))
    return walk.project_depths(regions, P.project_refs(spark, sf)).select("project", F.col("depth").cast("long").alias("depth"))


@_register(f"WITH {S.NODES}, {S.REFS} SELECT root, project FROM (WITH RECURSIVE c AS (SELECT src AS root, dst AS project FROM refs UNION SELECT root, dst FROM c JOIN refs ON src = project) SELECT * FROM c)")
def project_closure(spark, sf):
    return walk.closure(P.project_refs(spark, sf))


@_register(
    f"WITH {S.NODES}, {_DEPTH}, per AS (SELECT project, count(*) FILTER (WHERE kind IN ('type', 'interface', 'enum')) AS types, count(*) FILTER (WHERE {S.ENTRY}) AS entrypoints, count(*) FILTER (WHERE {S.TEST}) AS t, count(*) AS symbols FROM nodes GROUP BY project) "
    "SELECT per.project, types, entrypoints, symbols, CAST(coalesce(depth, 0) AS BIGINT) AS depth, t * 2 > symbols AS is_test, coalesce(r.refs, '') AS refs FROM per LEFT JOIN chain ON chain.project = per.project LEFT JOIN (SELECT src, string_agg(dst, ',' ORDER BY dst) AS refs FROM refs GROUP BY src) r ON r.src = per.project"
)
def map_projects(spark, sf):
    from ..tables import written

    refs = written(P.project_refs(spark, sf))
    names = P.table(spark, sf, "region").select(F.col("r_name").alias("project"))
    return rank.map_projects(P.index(spark, sf), refs, walk.project_depths(names, refs))


@_register(
    f"WITH {S.NODES}, e AS (SELECT lower(file) AS file, unnest(list_filter(tags, lambda t: starts_with(t, 'http:') OR t = 'handler')) AS tag, id FROM nodes WHERE {S.ENTRY} AND file <> '') "
    "SELECT file, count(DISTINCT id) AS entrypoints, array_to_string(list_sort(list_distinct(array_agg(split_part(tag, ':', 1)))), ',') AS kinds FROM e GROUP BY file ORDER BY entrypoints DESC, file LIMIT 5"
)
def map_entrypoints(spark, sf):
    return rank.map_entrypoints(P.index(spark, sf))


_BUSY = "SELECT n.id, n.short, count(*) AS callers FROM edges e JOIN nodes n ON n.id = e.dst WHERE e.kind <> 'TypeUse' AND NOT list_contains(n.tags, 'test') AND n.kind IN ({}) GROUP BY n.id, n.short HAVING count(*) > 1 ORDER BY callers DESC, n.id LIMIT {}"


@_register(f"WITH {S.GRAPH} " + _BUSY.format("'method', 'type', 'interface'", 5))
def map_busiest(spark, sf):
    return rank.busiest(P.index(spark, sf), ("method", "type", "interface"), 5)


@_register(f"WITH {S.GRAPH} " + _BUSY.format("'property', 'field', 'enum-member'", 3))
def map_most_read(spark, sf):
    return rank.busiest(P.index(spark, sf), ("property", "field", "enum-member"), 3)


@_register(f"WITH {S.PLACE}, {S.edges()} SELECT kind, count(*) AS edges, count(*) FILTER (WHERE score < 0.8) AS inferred, count(DISTINCT source) AS sources, round(min(score), 6) AS lowest FROM edges GROUP BY kind")
def doctor_quality(spark, sf):
    return rank.edge_quality(P.index(spark, sf))


@_register(f"WITH {S.PLACE}, {S.edges()} SELECT source, count(*) AS edges, round(min(confidence), 6) AS lowest FROM edges WHERE confidence IS NOT NULL GROUP BY source")
def doctor_inferred(spark, sf):
    return rank.inferred_by_source(P.index(spark, sf))


_USAGE = f"WITH {S.LOG} SELECT {{0}}, count(*) AS runs, CAST(median(ms) AS DOUBLE) AS median_ms, CAST(median(out_tokens) AS DOUBLE) AS median_tokens, count(DISTINCT session) AS sessions, count(*) FILTER (WHERE exit = 0) AS hits FROM log {{1}} GROUP BY {{0}}"


@_register(_USAGE.format("cmd", ""))
def usage_by_command(spark, sf):
    return rank.usage_by(P.usage_log(spark, sf), "cmd")


@_register(_USAGE.format("caller", "WHERE ts >= TIMESTAMP '2024-01-24 00:00:00'"))
def usage_by_caller(spark, sf):
    return rank.usage_by(P.usage_log(spark, sf), "caller", F.lit("2024-01-24 00:00:00").cast("timestamp"))


@_register(f"WITH {S.LOG} SELECT CAST(exit AS BIGINT) AS exit, CASE exit WHEN 0 THEN 'ok' WHEN 2 THEN 'not-found' WHEN 4 THEN 'ambiguous' WHEN 70 THEN 'over-budget' END AS name, count(*) AS runs FROM log GROUP BY exit")
def usage_exits(spark, sf):
    return rank.usage_exits(P.usage_log(spark, sf))


@_register(f"WITH {S.LOG} SELECT cmd FROM (VALUES ('click'), ('trace'), ('impl'), ('view')) t(cmd) WHERE cmd NOT IN (SELECT cmd FROM log)")
def usage_never_used(spark, sf):
    return rank.never_used(P.usage_log(spark, sf), spark.createDataFrame([("click",), ("trace",), ("impl",), ("view",)], "cmd string"))


# Neighbours of a node


@_register(
    f"WITH {S.GRAPH}, o AS (SELECT dst, kind, note, score, ord, row_number() OVER (PARTITION BY dst ORDER BY kind <> 'DiBinding', ord) AS rn, max(kind = 'DiBinding' OR coalesce(note = 'di-bound', FALSE)) OVER (PARTITION BY dst) AS bound, "
    f"min(site) FILTER (WHERE kind = 'DiBinding') OVER (PARTITION BY dst) AS site FROM edges WHERE src = {TARGET} AND kind IN ('Interface', 'Override', 'DiBinding')) "
    f"SELECT dst AS id, o.kind, note, score, {S.TEST} AS is_test, site, CAST(row_number() OVER (ORDER BY bound DESC, {S.TEST}, score DESC, ord) AS INTEGER) AS place FROM o JOIN nodes n ON n.id = dst WHERE rn = 1"
)
def impl(spark, sf):
    return rank.implementations(P.index(spark, sf), TARGET)


@_register(
    f"WITH {S.PLACE}, {S.edges()}, b AS (SELECT src, dst, site, row_number() OVER (PARTITION BY src ORDER BY score DESC, ord) AS rn, count(*) OVER (PARTITION BY src) AS total FROM edges WHERE kind = 'DiBinding') "
    "SELECT e.src, e.dst, e.kind, coalesce(e.site, x.site, t.site) AS site, CAST((x.dst IS NOT NULL)::INTEGER AS BIGINT) AS matching, coalesce(t.total, 0) AS total FROM edges e LEFT JOIN b x ON x.src = e.src AND x.dst = e.dst LEFT JOIN b t ON t.src = e.src AND t.rn = 1 WHERE e.kind IN ('Interface', 'Override')"
)
def hop_site(spark, sf):
    return rank.wiring_sites(P.index(spark, sf))


_OWNED = (
    "held AS (SELECT dst AS id, min_by(src, ord) AS owner FROM edges WHERE kind = 'TypeUse' AND note IN ('member', 'ctor') GROUP BY dst), tn AS (SELECT name, min(id) AS id FROM nodes WHERE kind IN ('type', 'interface', 'enum') GROUP BY name HAVING count(*) = 1), "
    "owned AS MATERIALIZED (SELECT n.id, coalesce(h.owner, t.id) AS owner FROM nodes n LEFT JOIN held h ON h.id = n.id LEFT JOIN tn t ON t.name = regexp_extract(n.name, '^(.*)\\.[^.]*$', 1) WHERE n.kind NOT IN ('type', 'interface', 'enum') AND coalesce(h.owner, t.id) IS NOT NULL)"
)


@_register(f"WITH {S.GRAPH}, {_OWNED} SELECT id, owner FROM owned")
def declaring_types(spark, sf):
    return walk.declaring_types(P.index(spark, sf))


@_register(
    f"WITH {S.GRAPH}, {_OWNED}, inside AS (SELECT id FROM nodes WHERE id = {TARGET} UNION SELECT dst FROM edges WHERE src = {TARGET} AND kind = 'TypeUse' AND note IN ('member', 'ctor')), c AS (SELECT DISTINCT src AS id FROM edges WHERE kind <> 'TypeUse' AND dst IN (SELECT id FROM inside)) "
    f"SELECT n.id, {S.TEST} AS is_test FROM c JOIN nodes n ON n.id = c.id LEFT JOIN owned o ON o.id = n.id WHERE n.id <> {TARGET} AND coalesce(o.owner, 0) <> {TARGET} AND NOT starts_with(n.name, (SELECT name || '.' FROM nodes WHERE id = {TARGET}))"
)
def direct_callers(spark, sf):
    return walk.direct_callers(P.index(spark, sf), TARGET)


@_register(
    f"WITH {S.PLACE}, {S.edges()}, d AS (SELECT src AS id FROM edges WHERE dst = {PARTNER} AND kind = 'Call' AND role & 2 <> 0), i AS (SELECT e.src AS id FROM edges e JOIN d ON d.id = e.dst WHERE e.kind = 'Interface') SELECT id, min(via) AS via FROM (SELECT id, 'direct' AS via FROM d UNION ALL SELECT id, 'via-interface' FROM i) GROUP BY id"
)
def blast_writes(spark, sf):
    return walk.writers(P.index(spark, sf), PARTNER)


# Walks

_BLAST = f"WITH {S.GRAPH}, {S.expanded('x', TARGET)}, {S.walk('x', 3, chr(101) + '.kind <> ' + chr(39) + 'TypeUse' + chr(39), f'(SELECT id FROM x WHERE id <> {TARGET})', backward=True)}"
_REACH = f"WITH {S.GRAPH}, {S.expanded('x', TARGET)}, {S.walk('x', 3, chr(101) + '.kind <> ' + chr(39) + 'TypeUse' + chr(39), 'x', backward=True)}"


@_register(f"{_BLAST} SELECT id, level, round(score, 6) AS score, source, parent FROM found")
def blast_radius(spark, sf):
    return walk.blast_radius(P.index(spark, sf), TARGET).select("id", "level", F.round("score", 6).alias("score"), "source", "parent")


@_register(f"{_BLAST} SELECT project, count(*) AS reached FROM found JOIN nodes USING (id) GROUP BY project")
def blast_projects(spark, sf):
    return walk.blast_projects(P.index(spark, sf), TARGET)


@_register(
    f"{_BLAST}, {_OWNED}, r AS (SELECT f.id, f.level, n.tags, n.kind FROM found f JOIN nodes n ON n.id = f.id) SELECT 'entrypoint' AS section, id FROM r WHERE {S.ENTRY} UNION ALL SELECT CASE WHEN {S.TEST} THEN 'direct-test' ELSE 'direct' END, id FROM r WHERE level = 1 "
    "UNION ALL SELECT DISTINCT 'indirect-type', CASE WHEN kind IN ('type', 'interface', 'enum') THEN r.id ELSE o.owner END FROM r LEFT JOIN owned o ON o.id = r.id WHERE level > 1 AND (kind IN ('type', 'interface', 'enum') OR o.owner IS NOT NULL)"
)
def blast_sections(spark, sf):
    return walk.blast_sections(P.index(spark, sf), TARGET)


@_register(f"{_REACH} SELECT id, level, round(score, 6) AS score FROM found")
def reverse_reach(spark, sf):
    return walk.reverse_reach(P.index(spark, sf), TARGET).select("id", "level", F.round("score", 6).alias("score"))


_FLOW_E = "e.kind IN ('Call', 'Mediatr', 'Interface', 'Override', 'Construct', 'Route') AND e.note IS DISTINCT FROM 'prop'"
_TRACE = f"WITH {S.GRAPH}, s AS (SELECT {START} AS id, 0 AS ord), " + S.walk("s", 3, _FLOW_E, "s", rank="(CASE WHEN e.note = 'di-bound' THEN 0 ELSE 1 END, CAST(round((1 - e.score) * 1000000) AS BIGINT), CASE WHEN e.kind = 'Construct' THEN 1 ELSE 0 END)", prune="l.kind = 'Construct' AND l.dst_kind = 'type'")


@_register(f"{_TRACE} SELECT level, parent, id, kind, note, round(score, 6) AS score FROM found")
def trace_bfs(spark, sf):
    return walk.trace(P.index(spark, sf), START, 3).select("level", "parent", "id", "kind", "note", F.round("score", 6).alias("score"))


@_register(f"{_TRACE}, c AS (SELECT level, sum(ceil((length(n.short) + 1) / 4.0)) AS cost FROM found f JOIN nodes n ON n.id = f.id GROUP BY level) SELECT CAST(coalesce(max(level), 1) AS INTEGER) AS depth FROM (SELECT level, sum(cost) OVER (ORDER BY level) AS upto FROM c) WHERE upto <= 0.85 * 600")
def trace_depth(spark, sf):
    g = P.index(spark, sf)
    rows = walk.trace(g, START, 3).join(g.nodes.select("id", "short"), "id")
    return walk.depth_that_fits(rows.select("level", token_cost("short").alias("cost")), 600)


_PATH = (
    f"WITH {S.GRAPH}, {S.expanded('a', START)}, {S.expanded('b', GOAL)}, " + S.walk("a", 12, _FLOW_E, "a", rank="CAST(round((1 - e.score) * 1000000) AS BIGINT)")
    + ", allf AS (SELECT * FROM found_0 UNION ALL SELECT * FROM found), hit AS (SELECT id, level FROM allf WHERE id IN (SELECT id FROM b) ORDER BY level, ord LIMIT 1), "
    "p AS (WITH RECURSIVE r AS (SELECT f.id, f.level, f.parent, f.kind, f.note FROM allf f JOIN hit ON f.id = hit.id UNION ALL SELECT f.id, f.level, f.parent, f.kind, f.note FROM r JOIN allf f ON f.id = r.parent) SELECT * FROM r)"
)


@_register(f"{_PATH} SELECT CAST(p.level AS INTEGER) AS hop, p.id, p.kind, p.note, coalesce(e.score, 1.0) AS score FROM p LEFT JOIN edges e ON e.src = p.parent AND e.dst = p.id AND e.kind = p.kind")
def path_rows(spark, sf):
    return walk.shortest_path(P.index(spark, sf), START, GOAL)


@_register(f"{_PATH} SELECT CAST(coalesce(max(level), 0) AS BIGINT) AS hops FROM p")
def path_hops(spark, sf):
    return walk.hops(P.index(spark, sf), START, GOAL)


_SHOWN = f"tp AS (SELECT project FROM nodes GROUP BY project HAVING count(*) FILTER (WHERE {S.TEST}) * 2 > count(*)), shown AS MATERIALIZED (SELECT * FROM nodes WHERE NOT {S.TEST} AND project NOT IN (SELECT project FROM tp) AND NOT contains(name, '<anonymous') AND NOT starts_with(name, '('))"


def _ring_sql(ways: str) -> str:
    return (
        f"WITH {S.GRAPH}, {_SHOWN}, e2 AS MATERIALIZED (SELECT src, dst FROM edges WHERE kind <> 'TypeUse' AND src IN (SELECT id FROM shown) AND dst IN (SELECT id FROM shown)), b AS MATERIALIZED ({ways}), "
        f"d AS (WITH RECURSIVE r(id, l) USING KEY (id) AS (SELECT id, CAST(0 AS BIGINT) FROM shown WHERE id = {START} UNION SELECT y, min(r.l) + 1 FROM r JOIN b ON x = r.id WHERE y NOT IN (SELECT id FROM recurring.r) GROUP BY y) SELECT * FROM r) "
        "SELECT CAST(l AS INTEGER) AS distance, l <= 1 AS within, count(*) AS nodes FROM d WHERE l > 0 GROUP BY l"
    )


@_register(_ring_sql("SELECT src AS x, dst AS y FROM e2 UNION SELECT dst, src FROM e2"))
def neighbourhood(spark, sf):
    return structure.around(P.index(spark, sf), START, 1)


@_register(_ring_sql("SELECT DISTINCT src AS x, dst AS y FROM e2"))
def neighbourhood_out(spark, sf):
    return structure.around(P.index(spark, sf), START, 1, "out")


@_register(_ring_sql("SELECT DISTINCT dst AS x, src AS y FROM e2"))
def neighbourhood_in(spark, sf):
    return structure.around(P.index(spark, sf), START, 1, "in")


# Names


@_register(
    f"WITH {S.NODES}, t AS (SELECT q, id, CASE WHEN lower(name) = lower(q) THEN 1 WHEN lower(short) = lower(q) THEN 2 WHEN ends_with(lower(name), '.' || lower(q)) OR ends_with(lower(short), '.' || lower(q)) THEN 3 "
    f"WHEN contains(q, '.') AND contains(lower(name), '.' || regexp_extract(lower(q), '^(.*)\\.[^.]*$', 1) || '.') AND ends_with(lower(name), '.' || split_part(lower(q), '.', -1)) THEN 4 WHEN contains(lower(short), lower(q)) THEN 5 END AS tier FROM nodes, {_values(QUESTIONS)}) "
    "SELECT q, CAST(tier AS INTEGER) AS tier, id FROM (SELECT *, min(tier) OVER (PARTITION BY q) AS m, row_number() OVER (PARTITION BY q, tier ORDER BY id) AS rn FROM t WHERE tier IS NOT NULL) WHERE tier = m AND (tier < 5 OR rn <= 40)"
)
def resolve_cascade(spark, sf):
    return resolve.resolve(P.index(spark, sf), _asked(spark, QUESTIONS))


def _tokens_sql(x: str) -> str:
    spaced = f"lower(regexp_replace(regexp_replace({x}, '([\\p{{Ll}}\\p{{N}}])(\\p{{Lu}})', '\\1 \\2', 'g'), '(\\p{{Lu}})(\\p{{Lu}}\\p{{Ll}})', '\\1 \\2', 'g'))"
    parts = f"list_distinct(list_filter(regexp_split_to_array({spaced}, '[_\\-. ]+'), lambda y: length(y) > 1))"
    return f"CASE WHEN len({parts}) > 0 THEN {parts} ELSE [lower({x})] END"


@_register(
    f"WITH {S.NODES}, q AS MATERIALIZED (SELECT q, split_part(q, '.', -1) AS ql, lower(regexp_extract(q, '^(.*)\\.[^.]*$', 1)) AS qo, {_tokens_sql('split_part(q, chr(46), -1)')} AS qt FROM {_values(MISSPELT)}), "
    f"n AS MATERIALIZED (SELECT id, short, split_part(short, '.', -1) AS leaf, {_tokens_sql('split_part(short, chr(46), -1)')} AS toks FROM nodes), "
    "p AS (SELECT *, len(list_intersect(toks, qt)) AS sh, qo <> '' AND contains(lower(short), qo) AS same FROM n, q), "
    "rough AS (SELECT *, CAST(trunc(sh / len(toks) * 55 + sh / len(qt) * 25) AS INTEGER) + CASE WHEN same THEN 30 ELSE 0 END AS rs, CASE WHEN same THEN 'same type' WHEN sh >= len(toks) THEN 'contains' ELSE 'shares words' END AS why FROM p WHERE sh > 0), "
    "sl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rs DESC, id) AS rn FROM rough) WHERE rn <= 60), "
    "sc AS (SELECT *, rs + CAST(trunc((1 - levenshtein(lower(leaf), lower(ql)) / greatest(length(leaf), length(ql))) * 20) AS INTEGER) AS score FROM sl), "
    "w AS MATERIALIZED (SELECT q, id, score, why FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, length(short), id) AS rn2 FROM sc WHERE score >= 30) WHERE rn2 <= 5), "
    "ty AS (SELECT q, id, short, 100 - 20 * levenshtein(lower(leaf), lower(ql)) AS score FROM p WHERE abs(length(leaf) - length(ql)) <= 3 AND lower(leaf[1]) = lower(ql[1]) AND levenshtein(lower(leaf), lower(ql)) BETWEEN 1 AND 3 AND q NOT IN (SELECT q FROM w)) "
    "SELECT q, id, CAST(score AS BIGINT) AS score, why FROM w UNION ALL SELECT q, id, CAST(score AS BIGINT), 'typo' FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, length(short), id) AS rn FROM ty) WHERE rn <= 5"
)
def suggest(spark, sf):
    return resolve.suggest(P.index(spark, sf), _asked(spark, MISSPELT))


def _lex(t: str) -> str:
    rules = [(100, f"lower(split_part(short, '.', -1)) = '{t}'"), (95, f"lower(short) = '{t}'"), (78, f"len(list_filter(tags, lambda x: (starts_with(x, 'route:') OR starts_with(x, 'http:')) AND contains(lower(x), '{t}'))) > 0"),
             (62, f"contains(lower(split_part(short, '.', -1)), '{t}')"), (52, f"contains(lower(short), '{t}')"), (40, f"contains(lower(name), '{t}')"), (28, f"contains(lower(file), '{t}')"), (16, f"contains(lower(signature), '{t}')")]
    return "CASE " + " ".join(f"WHEN {r} THEN {p}" for p, r in rules) + " ELSE 0 END"


_LEX = (
    f"lex AS MATERIALIZED (SELECT *, greatest(a, b) + CASE WHEN a > 0 AND b > 0 THEN 25 ELSE 0 END AS lexical, CASE greatest(a, b) WHEN 100 THEN 'name' WHEN 95 THEN 'name' WHEN 78 THEN 'route' WHEN 62 THEN 'name' WHEN 52 THEN 'container' WHEN 40 THEN 'namespace' WHEN 28 THEN 'path' ELSE 'signature' END AS why "
    f"FROM (SELECT *, {_lex(TERMS[0])} AS a, {_lex(TERMS[1])} AS b FROM nodes) WHERE a > 0 OR b > 0)"
)


@_register(f"WITH {S.NODES}, {_LEX} SELECT id, CAST(lexical AS INTEGER) AS lexical, why FROM lex")
def where_lexical(spark, sf):
    return resolve.where_lexical(P.index(spark, sf), list(TERMS)).select("id", "lexical", "why")


@_register(
    f"WITH {S.GRAPH}, {_LEX}, best AS MATERIALIZED (SELECT * FROM lex ORDER BY lexical DESC, length(short), id LIMIT 80), k AS (SELECT id AS key, id, id AS ord FROM best), "
    + S.walk("k", 4, "e.kind <> 'TypeUse'", "k", backward=True, key=True)
    + f", ep AS (SELECT f.key, count(DISTINCT f.id) AS n FROM found f JOIN nodes n ON n.id = f.id WHERE {S.ENTRY} GROUP BY f.key), ca AS (SELECT dst, count(*) AS n FROM edges WHERE kind <> 'TypeUse' GROUP BY dst), "
    "sc AS MATERIALIZED (SELECT b.*, coalesce(ep.n, 0) AS entrypoints, coalesce(ca.n, 0) AS callers, (lexical + 9 * least(coalesce(ep.n, 0), 8) + 3 * least(coalesce(ca.n, 0), 10) + CASE WHEN list_contains(tags, 'handler') THEN 12 ELSE 0 END "
    "+ CASE WHEN len(list_filter(tags, lambda x: starts_with(x, 'http:'))) > 0 THEN 14 ELSE 0 END + CASE WHEN kind IN ('method', 'property') THEN 6 ELSE 0 END) * CASE WHEN list_contains(tags, 'test') THEN 0.35 ELSE 1.0 END * CASE WHEN file = '' THEN 0.5 ELSE 1.0 END AS s0 FROM best b LEFT JOIN ep ON ep.key = b.id LEFT JOIN ca ON ca.dst = b.id), "
    "hd AS (SELECT short AS outer_, s0 AS cap FROM (SELECT *, row_number() OVER (PARTITION BY short ORDER BY lexical DESC, id) AS rn FROM sc) WHERE rn = 1), "
    "dm AS (SELECT sc.*, CASE WHEN why = 'container' AND cap IS NOT NULL THEN least(s0, cap - 0.001) ELSE s0 END AS score FROM sc LEFT JOIN hd ON outer_ = regexp_extract(short, '^(.*)\\.[^.]*$', 1)) "
    "SELECT id, CAST(lexical AS INTEGER) AS lexical, why, callers, entrypoints, round(CAST(score AS DOUBLE), 6) AS score FROM dm ORDER BY score DESC, lexical DESC, length(short), id LIMIT 8"
)
def where_ranked(spark, sf):
    return resolve.where(P.index(spark, sf), list(TERMS))


@_register(f"WITH {S.NODES}, {_LEX} SELECT key, id FROM lex")
def where_unranked(spark, sf):
    return resolve.where_unranked(P.index(spark, sf), list(TERMS))


# Structure

_NATIONS = "cg AS MATERIALIZED (SELECT DISTINCT src, dst FROM edges WHERE kind = 'Construct')"
_MUTUAL = "cl AS MATERIALIZED (WITH RECURSIVE r AS (SELECT src, dst FROM cg UNION SELECT r.src, g.dst FROM r JOIN cg g ON g.src = r.dst) SELECT * FROM r), scc AS MATERIALIZED (SELECT a.src AS node, min(a.dst) AS component FROM cl a JOIN cl b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst OR TRUE GROUP BY a.src HAVING count(*) > 1)"


def _constructs(spark, sf):
    return P.index(spark, sf).edges.where("kind = 'Construct'").select(F.col("src").alias("a"), F.col("dst").alias("b"))


@_register(f"WITH {S.PLACE}, {S.edges()}, {_NATIONS}, {_MUTUAL} SELECT node, component FROM scc")
def cycles_groups(spark, sf):
    return structure.components(_constructs(spark, sf))


@_register(f"WITH {S.GRAPH}, g AS (SELECT id, short AS grp FROM nodes WHERE kind IN ('type', 'interface') UNION ALL SELECT e.dst, min_by(n.short, e.ord) FROM edges e JOIN nodes n ON n.id = e.src JOIN nodes m ON m.id = e.dst WHERE e.kind = 'TypeUse' AND n.kind IN ('type', 'interface') AND m.kind NOT IN ('type', 'interface') GROUP BY e.dst) SELECT DISTINCT x.grp AS a, y.grp AS b FROM edges e JOIN g x ON x.id = e.src JOIN g y ON y.id = e.dst WHERE e.{S.FLOW.replace(' AND note', ' AND e.note')} AND x.grp <> y.grp")
def cycles_collapsed(spark, sf):
    return structure.collapsed(P.index(spark, sf), "type")


@_register(
    f"WITH {S.PLACE}, {S.edges()}, {_NATIONS}, {_MUTUAL}, g AS (SELECT CAST(src AS VARCHAR) AS a, CAST(dst AS VARCHAR) AS b FROM cg), s AS (SELECT min(CAST(node AS VARCHAR)) AS s FROM scc), "
    "w AS (WITH RECURSIVE r AS (SELECT [a, b] AS path FROM g JOIN s ON a = s UNION ALL SELECT list_append(path, b) FROM r JOIN g ON a = path[-1] JOIN s ON path[-1] <> s WHERE b = s OR NOT list_contains(path, b)) SELECT path FROM r), "
    "best AS (SELECT path FROM w JOIN s ON path[-1] = s ORDER BY len(path), path LIMIT 1) SELECT CAST(place AS INTEGER) AS place, path[place + 1] AS node FROM (SELECT path, unnest(range(0, len(path))) AS place FROM best)"
)
def cycles_loop(spark, sf):
    from ..tables import written

    edges = written(_constructs(spark, sf).select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")))
    first = structure.components(edges).agg(F.min("node").alias("n")).first()["n"]
    loop = structure.shortest_loop(edges, first) if first else []
    return spark.createDataFrame(list(enumerate(loop)), "place int, node string")


@_register("WITH e AS (SELECT c_custkey AS a, coalesce(lead(c_custkey) OVER (ORDER BY c_custkey), min(c_custkey) OVER ()) AS b FROM customer) SELECT a AS node, min(a) OVER () AS component FROM e WHERE a <> b")
def cycles_long(spark, sf):
    """One ring of all customers, in the order of their keys, with all orders hanging on it as tails."""
    keys = P.table(spark, sf, "customer").select("c_custkey")
    ends = keys.agg(F.min("c_custkey").alias("lo"), F.max("c_custkey").alias("hi")).first()
    # Keys are dense from the least on, so the next of each is known without ordering them.
    ring = keys.select(F.col("c_custkey").alias("a"), F.when(F.col("c_custkey") == ends["hi"], ends["lo"]).otherwise(F.col("c_custkey") + 1).alias("b"))
    tails = P.table(spark, sf, "orders").select(F.col("o_custkey").alias("a"), (-F.col("o_orderkey")).alias("b"))
    return structure.components(ring.unionByName(tails))


@_register("SELECT a.s_suppkey AS root, b.s_suppkey AS project FROM supplier a JOIN supplier b ON b.s_suppkey > a.s_suppkey")
def closure_long(spark, sf):
    """A chain of all suppliers, in the order of their keys, which are dense."""
    keys = P.table(spark, sf, "supplier").select("s_suppkey")
    return walk.closure(keys.join(keys.select((F.col("s_suppkey") - 1).alias("s_suppkey")), "s_suppkey", "left_semi").select(F.col("s_suppkey").alias("src"), (F.col("s_suppkey") + 1).alias("dst")))


_VIEW = "SELECT x.grp AS a, y.grp AS b, e.kind, CAST(bit_or(coalesce(role, 0)) AS BIGINT) AS role, round(min(score), 6) AS score, count(*) AS edges FROM edges e JOIN g x ON x.id = e.src JOIN g y ON y.id = e.dst WHERE e.kind <> 'TypeUse' AND x.grp <> y.grp GROUP BY 1, 2, 3"
_SPACES = "g AS MATERIALIZED (SELECT n.id, regexp_extract(coalesce(o.outer_, n.name), '^(.*)\\.[^.]*$', 1) AS grp FROM shown n LEFT JOIN (SELECT p.id, min_by(p.prefix, length(p.prefix)) AS outer_ FROM (SELECT id, array_to_string(list_slice(string_split(name, '.'), 1, k), '.') AS prefix FROM (SELECT id, name, unnest(range(1, len(string_split(name, '.')) + 1)) AS k FROM shown)) p WHERE p.prefix IN (SELECT name FROM nodes WHERE kind IN ('type', 'interface', 'enum')) GROUP BY p.id) o ON o.id = n.id)"


@_register(f"WITH {S.GRAPH}, {_SHOWN}, g AS (SELECT id, project AS grp FROM shown) {_VIEW}")
def export_project(spark, sf):
    return structure.exported(P.index(spark, sf), "project")


@_register(f"WITH {S.GRAPH}, {_SHOWN}, {_SPACES} {_VIEW}")
def export_namespace(spark, sf):
    return structure.exported(P.index(spark, sf), "namespace")


@_register(f"WITH {S.NODES} SELECT DISTINCT project AS name, 'n_' || substr(sha256(project), 1, 8) AS id FROM nodes")
def stable_ids(spark, sf):
    return structure.stable_ids(P.index(spark, sf).nodes.select(F.col("project").alias("name")))


def _drawn_sql(form: str) -> str:
    label = "kind || CASE WHEN score < 0.8 THEN ' ?' || printf('%.2f', score) ELSE '' END"
    dashed = "(role & 2 <> 0 OR score < 0.8)"
    if form == "mermaid":
        head, tail = "SELECT 0 AS part, '' AS sort, 'flowchart LR' AS line", ""
        node = "'  ' || id || '[\"' || " + S.mermaid("name") + " || '\"]'"
        edge = f"'  ' || x.id || CASE WHEN {dashed} THEN ' -. \"' ELSE ' -- \"' END || {label} || CASE WHEN {dashed} THEN '\" .-> ' ELSE '\" --> ' END || y.id"
    else:
        head, tail = "SELECT 0 AS part, '' AS sort, 'digraph G {' AS line", " UNION ALL SELECT 3, '', '}'"
        node = "'  \"' || id || '\" [label=\"' || " + S.dot("name") + " || '\"];'"
        edge = f"'  \"' || x.id || '\" -> \"' || y.id || '\" [label=\"' || {label} || CASE WHEN {dashed} THEN '\", style=dashed];' ELSE '\"];' END"
    return (
        f"WITH {S.GRAPH}, {_SHOWN}, g AS (SELECT id, project AS grp FROM shown), v AS MATERIALIZED ({_VIEW}), ids AS MATERIALIZED (SELECT name, 'n_' || substr(sha256(name), 1, 8) AS id FROM (SELECT a AS name FROM v UNION SELECT b FROM v)) "
        f"{head} UNION ALL SELECT 1, name, {node} FROM ids UNION ALL SELECT 2, a || chr(1) || b || chr(1) || kind, {edge} FROM v JOIN ids x ON x.name = a JOIN ids y ON y.name = b{tail}"
    )


def _drawn(form: str):
    def f(spark, sf):
        return structure.diagram(structure.exported(P.index(spark, sf), "project"), form).select("place.part", "place.sort", "line")

    return f


for _form in ("mermaid", "dot"):
    QUERIES[f"export_{_form}"], SQL[f"export_{_form}"] = _drawn(_form), _drawn_sql(_form)

# Snapshots

_FACTS = (
    "{0} AS MATERIALIZED (SELECT signature, max_by((kind, from_key, to_key, note, score), ord) AS r FROM (SELECT e.kind || chr(1) || a.key || chr(1) || b.key || chr(1) || coalesce(e.note, '') || chr(1) || concat_ws(', ', CASE WHEN role & 1 <> 0 THEN 'Read' END, CASE WHEN role & 2 <> 0 THEN 'Write' END, CASE WHEN role & 4 <> 0 THEN 'Subscribe' END) AS signature, "
    "e.kind, a.key AS from_key, b.key AS to_key, coalesce(e.note, '') AS note, e.score, e.ord FROM {1} e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE e.kind NOT IN ('TypeUse', 'Call', 'Construct')) GROUP BY signature)"
)
_CHANGES = (
    f"WITH {S.NODES}, {S.edges('e0', f'l_shipdate < TIMESTAMP {chr(39)}{SPLIT}{chr(39)}')}, {S.edges('e1')}, {_FACTS.format('f0', 'e0').replace('(kind, from_key, to_key, note, score)', chr(123) + chr(39) + 'kind' + chr(39) + ': kind, ' + chr(39) + 'from_key' + chr(39) + ': from_key, ' + chr(39) + 'to_key' + chr(39) + ': to_key, ' + chr(39) + 'note' + chr(39) + ': note, ' + chr(39) + 'score' + chr(39) + ': score' + chr(125))}, "
    f"{_FACTS.format('f1', 'e1').replace('(kind, from_key, to_key, note, score)', chr(123) + chr(39) + 'kind' + chr(39) + ': kind, ' + chr(39) + 'from_key' + chr(39) + ': from_key, ' + chr(39) + 'to_key' + chr(39) + ': to_key, ' + chr(39) + 'note' + chr(39) + ': note, ' + chr(39) + 'score' + chr(39) + ': score' + chr(125))}, "
    "ch AS MATERIALIZED (SELECT *, substr(sha256(relation || chr(1) || signature), 1, 12) AS id FROM (SELECT coalesce(f0.signature, f1.signature) AS signature, CASE WHEN f0.signature IS NULL THEN 'added' WHEN f1.signature IS NULL THEN 'removed' WHEN f0.r.score - f1.r.score > 0.05 THEN 'degraded' END AS relation, coalesce(f1.r, f0.r) AS r, f0.r.score AS before, f1.r.score AS now FROM f0 FULL JOIN f1 ON f0.signature = f1.signature) WHERE relation IS NOT NULL)"
)
_RANK = "CAST(CASE r.kind WHEN 'DiBinding' THEN 0 WHEN 'Mediatr' THEN 1 WHEN 'Route' THEN 2 WHEN 'Interface' THEN 3 WHEN 'Override' THEN 4 ELSE 5 END AS INTEGER) AS rank"


def _found(spark, sf):
    return compare.changes(compare.facts(P.index(spark, sf, SPLIT)), compare.facts(P.index(spark, sf)))


@_register(f"{_CHANGES} SELECT id, relation, {_RANK}, r.kind AS kind, r.from_key AS from_key, r.to_key AS to_key, r.note AS note, before, now FROM ch")
def changes(spark, sf):
    return _found(spark, sf)


@_register(f"{_CHANGES} SELECT id, relation, {_RANK}, r.kind AS kind, r.from_key AS from_key, r.to_key AS to_key, r.note AS note, before, now FROM ch WHERE relation = 'degraded' OR NOT starts_with(id, '0')")
def review_unaccepted(spark, sf):
    found = _found(spark, sf)
    return compare.unaccepted(found, found.where("relation <> 'degraded' AND id LIKE '0%'").select("id"))


_SHIFT = "e0 AS (SELECT * FROM ({0})), e1 AS (SELECT * FROM ({0}))"


def _bindings(moved: bool) -> str:
    note = "CASE WHEN (s_acctbal < 0) <> (s_suppkey % 5 = 0) THEN 'transient' ELSE 'scoped' END" if moved else "CASE WHEN s_acctbal < 0 THEN 'transient' ELSE 'scoped' END"
    return f"SELECT 'type|' || r_name || '.' || n_name AS from_key, 'type|' || r_name || '.' || n_name || '.' || s_name AS to_key, {note} AS note FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM supplier JOIN place ON s_nationkey = n_nationkey) WHERE rank <= 2"


@_register(f"WITH {S.PLACE}, o AS ({_bindings(False)}), n AS ({_bindings(True)}) SELECT o.from_key, o.to_key, o.note AS was, n.note AS becomes FROM o JOIN n USING (from_key, to_key) WHERE o.note <> n.note")
def lifetime_shifts(spark, sf):
    """Between the projected bindings and those in which every fifth supplier's lifetime is the other one."""
    g = P.index(spark, sf)
    other = F.when(F.col("note") == "scoped", "transient").otherwise("scoped")
    moved = g.edges.withColumn("note", F.when((F.col("kind") == "DiBinding") & (F.col("dst") % 5 == 0), other).otherwise(F.col("note")))
    return compare.lifetime_shifts(compare.changes(compare.facts(g), compare.facts(Graph(g.nodes, moved))))


_LINES = f"SELECT n_file AS file, 100 * c_custkey + 1 + nth AS line FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders) JOIN customer ON o_custkey = c_custkey JOIN place ON c_nationkey = n_nationkey WHERE o_orderdate = TIMESTAMP '1998-10-03' UNION SELECT n_file, 100 * c_custkey + 60 FROM customer JOIN place ON c_nationkey = n_nationkey WHERE c_custkey % 50 = 3 UNION SELECT n_file, 77 FROM place"


def _changed_lines(spark, sf):
    nodes = P.index(spark, sf).nodes
    day = P.table(spark, sf, "orders").where("o_orderdate = timestamp'1998-10-03'").select((P.ORDER + F.col("o_orderkey")).alias("id"))
    a = nodes.join(day, "id", "left_semi").select("file", F.col("line").cast("long").alias("line"))
    b = nodes.where("id BETWEEN 4000000000 AND 4999999999 AND id % 50 = 3").select("file", (F.col("line") + 59).cast("long").alias("line"))
    c = nodes.where("kind = 'type' AND file <> ''").select("file", F.lit(77).cast("long").alias("line"))
    return a.unionByName(b).unionByName(c).distinct()


_COVER = f"lines AS MATERIALIZED ({_LINES}), cover AS MATERIALIZED (SELECT file, line, id FROM (SELECT l.file, l.line, n.id, row_number() OVER (PARTITION BY l.file, l.line ORDER BY greatest(n.end_line, n.line) - n.line, n.kind IN ('type', 'interface', 'enum'), n.id) AS rn FROM lines l JOIN nodes n ON n.file = l.file AND l.line BETWEEN n.line AND greatest(n.end_line, n.line)) WHERE rn = 1)"


@_register(f"WITH {S.NODES}, {_COVER} SELECT file, CAST(line AS BIGINT) AS line, id FROM cover")
def diff_covering(spark, sf):
    return compare.covering(P.index(spark, sf), _changed_lines(spark, sf))


@_register(
    f"WITH {S.GRAPH}, {_COVER}, ch AS MATERIALIZED (SELECT DISTINCT id FROM cover), k AS MATERIALIZED (SELECT id AS key, id, 0 AS ord FROM ch UNION SELECT c.id, e.dst, e.ord FROM ch c JOIN nodes n ON n.id = c.id JOIN edges e ON e.src = c.id WHERE e.kind = 'TypeUse' AND n.kind IN ('type', 'interface', 'enum')), "
    + S.walk("k", 3, "e.kind <> 'TypeUse'", "k", backward=True, key=True)
    + f" SELECT f.id, round(max(f.score), 6) AS score, any_value({S.TEST}) AS is_test FROM found f JOIN nodes n ON n.id = f.id WHERE f.id NOT IN (SELECT id FROM ch) GROUP BY f.id"
)
def diff_impact(spark, sf):
    from ..tables import written

    g = P.index(spark, sf)
    changed = written(compare.covering(g, _changed_lines(spark, sf)).select("id").distinct())
    return compare.diff_impact(g, changed)


@_register("SELECT * FROM (VALUES ('src/a.cs', 3), ('src/a.cs', 10), ('src/a.cs', 11), ('src/b.cs', 7)) t(file, line)")
def diff_hunks(spark, sf):
    text = ["diff --git a/src/a.cs b/src/a.cs", "--- a/src/a.cs", "+++ b/src/a.cs", "@@ -3 +3 @@ class A", "-x", "+y", "@@ -9,0 +10,2 @@", "+p", "+q", "--- a/src/b.cs", "+++ b/src/b.cs", "@@ -8,2 +7,0 @@", "-gone", "-too", "--- a/c.cs", "+++ /dev/null", "@@ -1,2 +0,0 @@", "-z"]
    return compare.hunk_lines(spark.createDataFrame(list(enumerate(text)), "ord int, text string"))


# Explanations


@_register(f"WITH {S.PLACE}, {S.UNRESOLVED} SELECT kind, reason, sites, CAST(row_number() OVER (ORDER BY CASE kind WHEN 'di' THEN 0 WHEN 'mediatr' THEN 1 WHEN 'type' THEN 2 ELSE 3 END, sites DESC, kind, reason) AS INTEGER) AS place FROM (SELECT kind, reason, count(*) AS sites FROM sites GROUP BY kind, reason)")
def unresolved_groups(spark, sf):
    return explain.unresolved_totals(P.unresolved(spark, sf))


@_register(f"WITH {S.PLACE}, {S.UNRESOLVED} SELECT kind, reason, file, line, expression FROM (SELECT *, row_number() OVER (PARTITION BY kind, reason ORDER BY file, line, expression) AS rn FROM sites) WHERE rn <= 6")
def unresolved_sample(spark, sf):
    return explain.unresolved_sample(P.unresolved(spark, sf), ("kind", "reason")).select("kind", "reason", "file", "line", "expression")


@_register(f"WITH {S.PLACE}, {S.UNRESOLVED} SELECT kind, file, line, expression, reason, project FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY file, line, expression) AS rn FROM sites) WHERE rn <= CASE kind WHEN 'call' THEN 250 WHEN 'type' THEN 100 ELSE 75 END")
def unresolved_recorded(spark, sf):
    return bind.record_unresolved(P.unresolved(spark, sf))[1]


_REASONS = "rs AS MATERIALIZED (SELECT n.id, s.kind, s.reason, count(*) AS n FROM nodes n JOIN sites s ON s.file = n.file AND s.line BETWEEN n.line AND greatest(n.end_line, n.line) GROUP BY 1, 2, 3 UNION ALL SELECT id, 'interface', 'no-implementation', 1 FROM nodes WHERE kind = 'interface' AND id NOT IN (SELECT src FROM edges WHERE kind IN ('Interface', 'DiBinding')))"


@_register(f"WITH {S.GRAPH}, {S.UNRESOLVED}, {_REASONS} SELECT id, kind, reason, n FROM rs")
def silence_reasons(spark, sf):
    """Of every node. No walk follows, so the edges needn't be stored in buckets."""
    return explain.reasons(P.graph(spark, sf))


@_register(f"WITH {S.GRAPH}, {S.UNRESOLVED}, {_REASONS} SELECT (SELECT count(*) FROM edges WHERE src = {TARGET} AND {S.FLOW}) AS outgoing, (SELECT count(*) FROM edges WHERE dst = {TARGET} AND kind <> 'TypeUse') AS incoming, CAST(coalesce((SELECT sum(n) FROM rs WHERE id = {TARGET}), 0) AS BIGINT) AS reasons")
def silence(spark, sf):
    return explain.silence(P.index(spark, sf), TARGET)


@_register(f"WITH {S.GRAPH}, {S.expanded('x', START)}, " + S.walk("x", 12, _FLOW_E, "x", rank="CAST(round((1 - e.score) * 1000000) AS BIGINT)") + f" SELECT id, CAST(level AS INTEGER) AS level FROM (SELECT id, level FROM found_0 UNION ALL SELECT id, level FROM found) WHERE id NOT IN (SELECT src FROM edges WHERE {S.FLOW})")
def silence_dead_ends(spark, sf):
    return explain.dead_ends(P.index(spark, sf), START)


@_register(f"WITH {S.NODES}, {S.UNRESOLVED} SELECT kind, file, line, expression FROM sites WHERE contains(lower(expression), '\"k') ORDER BY file, line, expression LIMIT 20")
def silence_mentions(spark, sf):
    """The first mentions of `"k` in unresolved expressions, asked for through a node of that name."""
    g = P.index(spark, sf)
    named = g.nodes.unionByName(g.nodes.limit(1).withColumns({"id": F.lit(-1).cast("long"), "short": F.lit('x.{"k'), "file": F.lit("")}))
    return explain.mentions(Graph(named, g.edges, unresolved=g.unresolved), -1)


@_register(f"WITH {S.NODES} SELECT id, name, key, signature FROM nodes WHERE kind = 'method' AND lower(split_part(short, '.', -1)) = 'o77'")
def silence_overloads(spark, sf):
    return explain.overloads(P.index(spark, sf), "o77")


@_register(
    f"WITH {S.GRAPH}, {_OWNED}, {_REACH.split(', ', 0)[0].removeprefix('WITH ' + S.GRAPH + ', ')}, inside AS (SELECT id FROM nodes WHERE id = {TARGET} UNION SELECT dst FROM edges WHERE src = {TARGET} AND kind = 'TypeUse'), "
    f"ca AS MATERIALIZED (SELECT n.*, row_number() OVER (ORDER BY {S.TEST.replace('tags', 'n.tags')}, n.id) AS p FROM (SELECT DISTINCT src AS id FROM edges WHERE kind <> 'TypeUse' AND dst IN (SELECT id FROM inside)) c JOIN nodes n USING (id) LEFT JOIN owned o USING (id) WHERE n.id <> {TARGET} AND coalesce(o.owner, 0) <> {TARGET} AND NOT starts_with(n.name, (SELECT name || '.' FROM nodes WHERE id = {TARGET}))), "
    f"ce AS (SELECT n.*, row_number() OVER (ORDER BY b, s DESC, ord) AS p FROM (SELECT dst, CASE WHEN note = 'di-bound' THEN 0 ELSE 1 END AS b, score AS s, ord, row_number() OVER (PARTITION BY dst ORDER BY CASE WHEN note = 'di-bound' THEN 0 ELSE 1 END, score DESC, ord) AS rn FROM edges WHERE src = {TARGET} AND {S.FLOW}) e JOIN nodes n ON n.id = e.dst WHERE rn = 1), "
    f"im AS (SELECT n.*, row_number() OVER (ORDER BY bound DESC, sc DESC, ord) AS p FROM (SELECT dst, max(kind = 'DiBinding' OR coalesce(note = 'di-bound', FALSE)) AS bound, coalesce(max_by(score, -ord) FILTER (WHERE kind = 'DiBinding'), max_by(score, -ord)) AS sc, coalesce(min(ord) FILTER (WHERE kind = 'DiBinding'), min(ord)) AS ord FROM edges WHERE src = {TARGET} AND kind IN ('Interface', 'Override', 'DiBinding') GROUP BY dst) e JOIN nodes n ON n.id = e.dst), "
    f"me AS (SELECT n.*, row_number() OVER (ORDER BY n.kind = 'method', n.line, n.id) AS p FROM edges e JOIN nodes n ON n.id = e.dst WHERE e.src = {TARGET} AND e.kind = 'TypeUse'), ep AS (SELECT n.*, row_number() OVER (ORDER BY f.level, f.ord) AS p FROM found f JOIN nodes n ON n.id = f.id WHERE {S.ENTRY.replace('tags', 'n.tags')}), "
    "fi AS (SELECT lower(file) AS file, row_number() OVER (ORDER BY min((g, p))) AS p FROM (SELECT file, 0 AS g, 0 AS p FROM nodes WHERE id = " + str(TARGET) + " UNION ALL SELECT file, 1, p FROM ca WHERE p <= 12 UNION ALL SELECT file, 2, p FROM ce WHERE p <= 12 UNION ALL SELECT file, 3, p FROM im WHERE p <= 8 UNION ALL SELECT file, 4, p FROM ep WHERE p <= 10) WHERE file <> '' GROUP BY lower(file)) "
    "SELECT 'ROLE' AS section, CAST(1 AS BIGINT) AS place, 'type' AS text UNION ALL SELECT 'MEMBERS', p, short FROM me WHERE p <= 20 UNION ALL SELECT 'CALLED BY', p, short FROM ca WHERE p <= 12 UNION ALL SELECT 'CALLS', p, short FROM ce WHERE p <= 12 UNION ALL SELECT 'IMPLEMENTATION', p, short FROM im WHERE p <= 8 UNION ALL SELECT 'ENTRYPOINTS', p, short FROM ep WHERE p <= 10 "
    "UNION ALL SELECT 'IMPACT', 1, (SELECT count(*) FROM ca) || ' direct caller(s), ' || (SELECT count(*) FROM found) || ' reachable member(s), ' || (SELECT least(count(*), 10) FROM ep) || ' entrypoint(s)' UNION ALL SELECT 'FILES', p, file FROM fi WHERE p <= 10"
)
def context_sections(spark, sf):
    return explain.context(P.index(spark, sf), TARGET)


# Budgets, bindings and upkeep


@_register(
    f"WITH {S.NODES}, c AS (SELECT project, id, short, CAST(ceil((length(short) + 1) / 4.0) AS BIGINT) AS cost FROM nodes), w AS (SELECT *, CAST(sum(cost) OVER (PARTITION BY project ORDER BY id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto, sum(cost) OVER (PARTITION BY project) > 560 AS cut FROM c) SELECT project, id, short, cost, upto, cut FROM w WHERE upto <= 560"
)
def budget_prefix(spark, sf):
    """What fits an answer of 600 tokens of which 40 are kept for a closing mark, by project."""
    return rank.within_budget(P.index(spark, sf).nodes.select("project", "id", "short"), token_cost("short"), [F.col("id")], 560, ["project"])


def _sends(spark, sf):
    part = P.table(spark, sf, "part").select("p_partkey", "p_brand", "p_name")
    items = P.table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    sends = items.select(F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("site"), F.concat_ws(".", "p_brand", "p_name").alias("request"), F.col("p_name").alias("short"), (F.col("l_linenumber") % 2 == 0).alias("bound")).distinct()
    keyed = part.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("handler"), F.concat_ws(".", "p_brand", "p_name").alias("request"), F.col("p_name").alias("short"))
    loose = part.where("p_partkey % 40 = 1").select(F.col("p_partkey").alias("handler"), F.lit(None).cast("string").alias("request"), F.col("p_name").alias("short"))
    return sends, keyed.unionByName(loose)


_SENDS = (
    "sends AS MATERIALIZED (SELECT DISTINCT l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS site, p_brand || '.' || p_name AS request, p_name AS short, l_linenumber % 2 = 0 AS bound FROM lineitem JOIN part ON l_partkey = p_partkey), keyed AS (SELECT p_partkey AS handler, p_brand || '.' || p_name AS request, p_name AS short FROM part WHERE p_partkey % 3 = 0), "
    "loose AS (SELECT p_partkey AS handler, p_name AS short FROM part WHERE p_partkey % 40 = 1), shorts AS (SELECT short, count(DISTINCT request) AS keys, min(request) AS only_ FROM keyed GROUP BY short), rest AS (SELECT * FROM sends WHERE bound AND request NOT IN (SELECT request FROM keyed))"
)


@_register(
    f"WITH {_SENDS}, e AS (SELECT site, handler, 1.0 AS c FROM sends JOIN keyed USING (request) WHERE bound UNION ALL SELECT site, handler, 0.7 FROM rest JOIN loose USING (short) UNION ALL SELECT site, handler, 0.7 FROM sends s JOIN shorts USING (short) JOIN keyed k ON k.request = only_ WHERE NOT bound AND keys = 1) "
    "SELECT handler, CASE WHEN c = 1.0 THEN 'semantic-request' ELSE 'short-name-match' END AS source, CAST(c AS DOUBLE) AS confidence, count(*) AS edges FROM e GROUP BY ALL"
)
def dispatch_tiers(spark, sf):
    return bind.dispatch(*_sends(spark, sf))[0].groupBy("handler", "source", "confidence").agg(F.count(F.lit(1)).alias("edges"))


@_register(
    f"WITH {_SENDS}, f AS (SELECT CASE WHEN keys IS NULL THEN 'no-handler' ELSE 'ambiguous-request-name' END AS reason FROM rest LEFT JOIN shorts USING (short) WHERE short NOT IN (SELECT short FROM loose) UNION ALL SELECT CASE WHEN keys IS NULL THEN 'no-handler' ELSE 'ambiguous-request-name' END FROM sends LEFT JOIN shorts USING (short) WHERE NOT bound AND (keys IS NULL OR keys > 1)) SELECT reason, count(*) AS sites FROM f GROUP BY reason"
)
def dispatch_failures(spark, sf):
    return bind.dispatch(*_sends(spark, sf))[1].groupBy("reason").agg(F.count(F.lit(1)).alias("sites"))


@_register("SELECT p_brand || '.' || p_name AS request, array_to_string(list_sort(array_agg(DISTINCT p_partkey)), ',') AS handlers FROM part GROUP BY 1")
def handler_registry(spark, sf):
    rows = P.table(spark, sf, "part").select(F.concat_ws(".", "p_brand", "p_name").alias("request"), F.col("p_partkey").alias("handler"))
    return bind.handler_registry(rows).select("request", F.array_join(F.col("handlers").cast("array<string>"), ",").alias("handlers"))


_TYPES = "types AS (SELECT s_suppkey AS id, s_name AS key, CASE WHEN s_suppkey % 4 = 0 THEN 'Repo' || (s_suppkey % 20) ELSE s_name END AS short FROM supplier), uses AS (SELECT l_orderkey || ':' || l_linenumber || ':' || l_suppkey || ':' || l_partkey AS site, CASE WHEN l_suppkey % 9 = 0 THEN 'Elsewhere' ELSE s_name END AS key, CASE WHEN l_suppkey % 4 = 0 THEN 'Repo' || (l_suppkey % 20) WHEN l_suppkey % 4 = 1 THEN 'Nowhere' ELSE s_name END AS short, l_linenumber % 2 = 0 AS known FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"


def _registrations(spark, sf):
    s, item = P.table(spark, sf, "supplier"), P.table(spark, sf, "lineitem")
    repo = F.concat(F.lit("Repo"), (F.col("s_suppkey") % 20).cast("string"))
    types = s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("key"), F.when(F.col("s_suppkey") % 4 == 0, repo).otherwise(F.col("s_name")).alias("short"))
    site = F.concat_ws(":", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")))
    uses = item.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(site.alias("site"), F.when(F.col("s_suppkey") % 9 == 0, "Elsewhere").otherwise(F.col("s_name")).alias("key"), F.when(F.col("s_suppkey") % 4 == 0, repo).when(F.col("s_suppkey") % 4 == 1, "Nowhere").otherwise(F.col("s_name")).alias("short"), (F.col("l_linenumber") % 2 == 0).alias("known"))
    return bind.registration(uses, types)


@_register(f"WITH {_TYPES}, sh AS (SELECT short, count(*) AS n, min(id) AS id FROM types GROUP BY short), e AS (SELECT t.id, 1.0 AS c FROM uses u JOIN types t USING (key) WHERE known UNION ALL SELECT sh.id, 0.65 FROM uses JOIN sh USING (short) WHERE NOT known AND n = 1) SELECT id, CAST(c AS DOUBLE) AS confidence, CASE WHEN c = 1.0 THEN 'semantic-registration' ELSE 'short-name-match' END AS source, count(*) AS edges FROM e GROUP BY ALL")
def di_tiers(spark, sf):
    return _registrations(spark, sf)[0].groupBy("id", "confidence", "source").agg(F.count(F.lit(1)).alias("edges"))


@_register(f"WITH {_TYPES}, sh AS (SELECT short, count(*) AS n FROM types GROUP BY short), f AS (SELECT 'type-outside-index' AS reason FROM uses WHERE known AND key NOT IN (SELECT key FROM types) UNION ALL SELECT CASE WHEN n IS NULL THEN 'type-not-found' ELSE 'ambiguous-type-name' END FROM uses LEFT JOIN sh USING (short) WHERE NOT known AND (n IS NULL OR n > 1)) SELECT reason, count(*) AS sites FROM f GROUP BY reason")
def di_failures(spark, sf):
    return _registrations(spark, sf)[1].groupBy("reason").agg(F.count(F.lit(1)).alias("sites"))


@_register(f"WITH {S.PLACE} SELECT n_name AS service, s_suppkey AS id, CAST(CASE WHEN n_nationkey % 2 = 0 THEN 0.75 ELSE 0.55 END AS DOUBLE) AS confidence, CASE WHEN n_nationkey % 2 = 0 THEN 'assembly-scan' ELSE 'assembly-scan-broad' END AS source FROM supplier JOIN place ON s_nationkey = n_nationkey WHERE n_nationkey % 2 = 0 OR r_name = 'ASIA'")
def scan_bindings(spark, sf):
    place = P._places(spark, sf)
    own = P.table(spark, sf, "supplier").join(place, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("r_name").alias("project"), F.col("n_name").alias("service"), F.col("s_suppkey").alias("id"))
    scans = place.where("n_nationkey % 2 = 0").select(F.col("r_name").alias("project"), F.col("n_name").alias("service")).unionByName(spark.sql("SELECT 'ASIA' AS project, CAST(NULL AS STRING) AS service"))
    return bind.scan(own, scans)


@_register(f"WITH {S.PLACE}, {S.edges()} SELECT e.src, e.dst, CASE WHEN b.src IS NOT NULL THEN 'di-bound' END AS note FROM edges e LEFT JOIN edges b ON b.src = e.src AND b.dst = e.dst AND b.kind = 'DiBinding' AND b.score >= 0.8 WHERE e.kind = 'Interface'")
def indirection(spark, sf):
    e = P.index(spark, sf).edges
    return bind.indirection(e.where("kind = 'Interface'").select("src", "dst"), e.where("kind = 'DiBinding'"))


@_register(
    f"WITH {S.NODES}, u AS (SELECT 'type' || (event_id % 20) AS name, event_type AS assembly, n_file || ':' || event_id AS site FROM events JOIN place ON user_id % 25 = n_nationkey), k AS (SELECT name, assembly, site, row_number() OVER (PARTITION BY name, assembly ORDER BY site) AS rn FROM (SELECT DISTINCT * FROM u)) "
    "SELECT name, assembly, string_agg(site, ',' ORDER BY site) AS sites FROM k WHERE rn <= 6 GROUP BY name, assembly ORDER BY name, assembly LIMIT 150"
)
def external_types(spark, sf):
    place = P._places(spark, sf)
    e = P.table(spark, sf, "events").join(place, F.col("user_id") % 25 == F.col("n_nationkey"))
    uses = e.select(F.concat(F.lit("type"), (F.col("event_id") % 20).cast("string")).alias("name"), F.col("event_type").alias("assembly"), F.concat("n_file", F.lit(":"), F.col("event_id").cast("string")).alias("site"))
    return bind.record_external(uses).withColumn("sites", F.array_join("sites", ","))


@_register("SELECT project, code, count FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY count DESC, code) AS rn FROM (SELECT event_type AS project, 'CS' || (user_id % 40 + 8770) AS code, count(*) AS count FROM events GROUP BY 1, 2)) WHERE rn <= 8 OR code = 'CS8795'")
def diagnostics(spark, sf):
    e = P.table(spark, sf, "events").select(F.col("event_type").alias("project"), F.concat(F.lit("CS"), (F.col("user_id") % 40 + 8770).cast("string")).alias("code"))
    return bind.record_diagnostics(e)


@_register(f"WITH {S.GRAPH}, t AS (SELECT DISTINCT e.dst AS id FROM edges e JOIN nodes n ON n.id = e.src WHERE e.kind = 'TypeUse' AND n.kind = 'type' AND n.id % 7 = 0) SELECT n.id, array_to_string(CASE WHEN (n.kind = 'type' AND n.id % 7 = 0 OR n.id IN (SELECT id FROM t)) AND NOT {S.TEST} THEN list_append(tags, 'test') ELSE tags END, ',') AS tags FROM nodes n")
def test_propagation(spark, sf):
    """With every seventh type tagged a test."""
    g = P.index(spark, sf)
    tag = F.when((F.col("kind") == "type") & (F.col("id") % 7 == 0), F.array_union("tags", F.array(F.lit("test")))).otherwise(F.col("tags"))
    return bind.propagate_tests(Graph(g.nodes.withColumn("tags", tag), g.edges)).withColumn("tags", F.array_join("tags", ","))


_DIRTY = "dirty AS (SELECT n_file AS file FROM place WHERE n_nationkey < 3)"


def _patched(spark, sf):
    """The files of three places change: every tenth node of theirs goes, one comes, and the calls of the others are found again."""
    from ..tables import written

    g = P.index(spark, sf)
    dirty = P._places(spark, sf).where("n_nationkey < 3").select(F.col("n_file").alias("file"))
    own = g.nodes.join(dirty, "file", "left_semi")
    new = own.where("id % 10 <> 0")
    extra = new.orderBy("id").limit(1).withColumns({"id": F.lit(None).cast("long"), "key": F.lit("method|new"), "name": F.lit("new"), "short": F.lit("new")})
    keys = g.nodes.select("id", "key")
    back = g.edges.join(own.where("id % 10 <> 0").select(F.col("id").alias("src")), "src", "left_semi").join(keys.withColumnsRenamed({"id": "src", "key": "src_key"}), "src").join(keys.withColumnsRenamed({"id": "dst", "key": "dst_key"}), "dst").drop("src", "dst")
    return bind.patch(g, dirty, written(new.unionByName(extra)), written(back))


@_register(f"WITH {S.GRAPH}, {_DIRTY}, kept AS (SELECT id FROM nodes WHERE file NOT IN (SELECT file FROM dirty) OR id % 10 <> 0) SELECT src, dst, kind FROM edges WHERE src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM kept)")
def incremental_edges(spark, sf):
    return _patched(spark, sf).edges.select("src", "dst", "kind")


@_register(f"WITH {S.NODES}, {_DIRTY} SELECT id, key FROM nodes WHERE file NOT IN (SELECT file FROM dirty) OR id % 10 <> 0 UNION ALL SELECT (SELECT max(id) + 1 FROM nodes), 'method|new'")
def incremental_upsert(spark, sf):
    return _patched(spark, sf).nodes.select("id", "key")


@_register(
    f"WITH {S.GRAPH}, tp AS (SELECT project FROM nodes GROUP BY project HAVING count(*) FILTER (WHERE {S.TEST}) * 2 > count(*)), n AS MATERIALIZED (SELECT id, project, {S.TEST} OR project IN (SELECT project FROM tp) AS t FROM nodes), "
    "w AS (SELECT CASE WHEN e.kind = 'TypeUse' THEN 'type_use' WHEN a.t OR b.t THEN 'tests' WHEN a.project = b.project THEN 'within' ELSE 'drawn' END AS why FROM edges e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst) "
    "SELECT count(*) FILTER (WHERE why = 'type_use') AS type_use, count(*) FILTER (WHERE why = 'tests') AS tests, CAST(0 AS BIGINT) AS synthetic, count(*) FILTER (WHERE why = 'within') AS within, count(*) FILTER (WHERE why = 'drawn') AS drawn FROM w"
)
def export_withheld(spark, sf):
    return structure.withheld(P.index(spark, sf), "project")


@_register(f"{_CHANGES}, c AS (SELECT id, relation, {_RANK}, r.kind AS kind, r.from_key AS from_key, r.to_key AS to_key FROM ch) SELECT relation, rank, kind, CAST(place AS INTEGER) AS place, id, from_key, to_key, CAST(greatest(n - 20, 0) AS BIGINT) AS left FROM (SELECT *, row_number() OVER (PARTITION BY relation, kind ORDER BY from_key, to_key, id) AS place, count(*) OVER (PARTITION BY relation, kind) AS n FROM c) WHERE place <= 20".replace("AS left FROM", 'AS "left" FROM'))
def changes_report(spark, sf):
    return compare.report(_found(spark, sf))


@_register(f"{_CHANGES} SELECT id, r.kind AS kind, r.from_key AS from_key, r.to_key AS to_key FROM ch c WHERE relation = 'removed' AND r.kind IN ('DiBinding', 'Mediatr') AND NOT EXISTS (SELECT 1 FROM ch a WHERE a.relation = 'added' AND a.r.kind = c.r.kind AND a.r.from_key = c.r.from_key)")
def changes_lost(spark, sf):
    return compare.lost_wiring(_found(spark, sf))


_DEAD = f"WITH {S.GRAPH}, {S.UNRESOLVED}, {_REASONS}, {S.expanded('x', START)}, " + S.walk("x", 12, _FLOW_E, "x", rank="CAST(round((1 - e.score) * 1000000) AS BIGINT)")


@_register(f"{_DEAD}, d AS (SELECT DISTINCT id FROM (SELECT id FROM found_0 UNION ALL SELECT id FROM found) WHERE id NOT IN (SELECT src FROM edges WHERE {S.FLOW})) SELECT 'dead-end' AS answer, d.id, CAST(coalesce(w.n, 0) AS BIGINT) AS n FROM d LEFT JOIN (SELECT id, count(*) AS n FROM rs GROUP BY id) w ON w.id = d.id ORDER BY n DESC, d.id LIMIT 5")
def silence_between(spark, sf):
    return explain.silence_between(P.index(spark, sf), START, PARTNER)


@_register(f"WITH {S.LOG} SELECT ts, cmd, caller, exit FROM log ORDER BY ts DESC, session, cmd LIMIT 10")
def usage_tail(spark, sf):
    return rank.usage_tail(P.usage_log(spark, sf))


@_register("WITH c AS (SELECT 'u' || (user_id % 7) AS project, event_type FROM events) SELECT project, count(*) AS calls, count(*) FILTER (WHERE event_type = 'error') AS failed, floor(1000 * count(*) FILTER (WHERE event_type <> 'error') / count(*)) / 10 AS rate FROM c GROUP BY project")
def doctor_resolution(spark, sf):
    calls = P.table(spark, sf, "events").select(F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string")).alias("project"), "event_type")
    return rank.resolution(calls.where("event_type = 'error'"), calls, "project")


@_register(f"WITH {S.NODES}, {S.REFS} SELECT project FROM (WITH RECURSIVE c AS (SELECT 'AMERICA' AS project UNION SELECT dst FROM c JOIN refs ON src = project) SELECT * FROM c)")
def project_scope(spark, sf):
    return walk.scope(P.project_refs(spark, sf), spark.createDataFrame([("AMERICA",)], "project string"))


@_register(f"WITH {S.NODES}, c AS (SELECT project, id, CAST(ceil((length(short) + 1) / 4.0) AS BIGINT) AS cost FROM nodes), w AS (SELECT *, sum(cost) OVER (PARTITION BY project ORDER BY id ROWS UNBOUNDED PRECEDING) AS upto FROM c) SELECT project, count(*) FILTER (WHERE upto <= 800 - 40 - 60) AS shown, count(*) AS total, CAST(sum(cost) AS BIGINT) AS cost, CAST(CASE WHEN sum(cost) + 110 <= 4000 THEN sum(cost) + 110 END AS BIGINT) AS fits FROM w GROUP BY project")
def budget_fit(spark, sf):
    lines = P.index(spark, sf).nodes.select("project", "id", F.col("short").alias("text"))
    return rank.answer_lines(lines, [F.col("id")], 800, ["project"], opening=75)[1]


_MISSING = ("HttpClient", "A:B", "/orders/7", "Customr#000000012", "zzz")


@_register("SELECT * FROM (VALUES ('HttpClient', 'external', 'System.Net.Http', CAST(NULL AS BIGINT)), ('A:B', 'configuration-key', '', NULL), ('/orders/7', 'route', '', NULL), ('zzz', 'nothing', '', NULL)) t(q, answer, text, id)")
def missing_names(spark, sf):
    g = P.index(spark, sf)
    outside = spark.createDataFrame([("HttpClient", "System.Net.Http", ["a.cs:1"])], "name string, assembly string, sites array<string>")
    return resolve.missing(Graph(g.nodes, g.edges, external_types=outside), _asked(spark, tuple(x for x in _MISSING if "#" not in x)))


from . import stores as _stores  # noqa: E402, F401  adds its queries to those above
