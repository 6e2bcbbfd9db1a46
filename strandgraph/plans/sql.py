"""SQL that any engine can run on the tables for what the registered queries compute."""

from __future__ import annotations

_NODE = "SELECT {id} AS id, '{kind}|' || {name} AS key, {name} AS name, {short} AS short, '{kind}' AS kind, {file} AS file, CAST({line} AS INTEGER) AS line, CAST({end} AS INTEGER) AS end_line, {short} || '()' AS signature, {project} AS project, {tags} AS tags FROM {table}"
_NONE, _TEST = "CAST([] AS VARCHAR[])", "CASE WHEN c_mktsegment = 'MACHINERY' THEN ['test'] ELSE CAST([] AS VARCHAR[]) END"


def _nodes() -> str:
    home = "{} JOIN place ON {} = n_nationkey"
    c, s = home.format("customer", "c_nationkey"), home.format("supplier", "s_nationkey")
    o = f"(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders) JOIN customer ON o_custkey = c_custkey JOIN place ON c_nationkey = n_nationkey"
    tags = f"(CASE WHEN c_mktsegment = 'BUILDING' THEN ['http:GET /customer/' || c_custkey] WHEN c_mktsegment = 'AUTOMOBILE' THEN ['handler'] ELSE {_TEST} END)"
    rows = [
        dict(id="1000000000 + r_regionkey", kind="interface", name="r_name", short="r_name", project="r_name", file="''", line=0, end=0, tags=_NONE, table="region"),
        dict(id="2000000000 + n_nationkey", kind="type", name="(r_name || '.' || n_name)", short="n_name", project="r_name", file="n_file", line=1, end=2000000000, tags=_NONE, table="place"),
        dict(id="3000000000 + s_suppkey", kind="type", name="(r_name || '.' || n_name || '.' || s_name)", short="(n_name || '.' || s_name)", project="r_name", file="''", line=0, end=0, tags="['repository']", table=s),
        dict(id="4000000000 + c_custkey", kind="method", name="(r_name || '.' || n_name || '.' || c_name)", short="(n_name || '.' || c_name)", project="r_name", file="n_file", line="100 * c_custkey + 1", end="100 * c_custkey + 99", tags=tags, table=c),
        dict(id="5000000000 + o_orderkey", kind="method", name="(r_name || '.' || n_name || '.' || c_name || '.O' || o_orderkey)", short="(c_name || '.O' || o_orderkey)", project="r_name", file="n_file", line="100 * c_custkey + 1 + nth", end="100 * c_custkey + 1 + nth", tags=_TEST, table=o),
        dict(id="6000000000 + p_partkey", kind="property", name="(p_brand || '.' || p_name || '.P' || p_partkey)", short="(p_name || '.P' || p_partkey)", project="p_brand", file="''", line=0, end=0, tags=_NONE, table="part"),
    ]
    return " UNION ALL ".join(_NODE.format(**r) for r in rows)


PLACE = "place AS MATERIALIZED (SELECT n_nationkey, n_name, r_regionkey, r_name, r_name || '/' || n_name AS n_file FROM nation JOIN region ON n_regionkey = r_regionkey)"
NODES = f"{PLACE}, nodes AS MATERIALIZED ({_nodes()})"


def edges(name: str = "edges", where: str = "TRUE") -> str:
    edge = "SELECT {} AS src, {} AS dst, '{}' AS kind, CAST({} AS VARCHAR) AS note, CAST({} AS DOUBLE) AS confidence, CAST({} AS VARCHAR) AS source, CAST({} AS VARCHAR) AS site, CAST({} AS INTEGER) AS role FROM {}"
    home = "(SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM supplier JOIN place ON s_nationkey = n_nationkey)"
    trade = f"(SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY revenue DESC, s_nationkey) AS rank FROM (SELECT c_nationkey, s_nationkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey AND {where} GROUP BY 1, 2))"
    sent = f"(SELECT l_orderkey, l_suppkey, min(l_returnflag) AS flag, max(l_discount) AS discount FROM lineitem WHERE {where} GROUP BY 1, 2)"
    used = f"(SELECT l_orderkey, l_partkey, bit_or(CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 4 END) AS role, 'lineitem:' || coalesce(min(l_linenumber) FILTER (WHERE l_returnflag = 'R'), min(l_linenumber)) AS site FROM lineitem WHERE {where} GROUP BY 1, 2)"
    nation, sup = "2000000000 + s_nationkey", "3000000000 + s_suppkey"
    rows = [
        edge.format("1000000000 + r_regionkey", "2000000000 + n_nationkey", "TypeUse", "'member'", *["NULL"] * 4, "place"),
        edge.format("2000000000 + c_nationkey", "4000000000 + c_custkey", "TypeUse", "'member'", *["NULL"] * 4, "customer"),
        edge.format(nation, sup, "TypeUse", "'member'", *["NULL"] * 4, "supplier"),
        edge.format(nation, sup, "Interface", "CASE WHEN rank <= 2 THEN 'di-bound' END", *["NULL"] * 4, home),
        edge.format(nation, sup, "DiBinding", "CASE WHEN s_acctbal < 0 THEN 'transient' ELSE 'scoped' END", "CASE WHEN rank = 2 THEN 0.9 END", "CASE WHEN rank = 2 THEN 'factory-lambda' ELSE 'semantic-registration' END", "n_file || ':' || s_suppkey", "NULL", f"{home} WHERE rank <= 2"),
        edge.format("2000000000 + c_nationkey", nation, "Construct", *["NULL"] * 5, f"{trade} WHERE rank <= 2"),
        edge.format("4000000000 + o_custkey", "5000000000 + o_orderkey", "Call", *["NULL"] * 5, "orders"),
        edge.format("5000000000 + l_orderkey", "3000000000 + l_suppkey", "Mediatr", "'via Send(' || flag || ')'", "CASE WHEN discount >= 0.09 THEN 0.7 END", "CASE WHEN discount >= 0.09 THEN 'short-name-match' ELSE 'semantic-request' END", "NULL", "NULL", sent),
        edge.format("5000000000 + l_orderkey", "6000000000 + l_partkey", "Call", "'prop'", "NULL", "NULL", "site", "role", used),
    ]
    return f"{name} AS MATERIALIZED (SELECT *, coalesce(confidence, 1.0) AS score, row_number() OVER (ORDER BY src, dst, kind) AS ord FROM ({' UNION ALL '.join(rows)}))"


GRAPH = f"{NODES}, {edges()}"
FLOW = "kind IN ('Call', 'Mediatr', 'Interface', 'Override', 'Construct', 'Route') AND note IS DISTINCT FROM 'prop'"
ENTRY = "len(list_filter(tags, lambda t: starts_with(t, 'http:') OR starts_with(t, 'endpoint:') OR t IN ('handler', 'consumer', 'hosted', 'action'))) > 0"
TEST = "list_contains(tags, 'test')"
UNRESOLVED = (
    "sites AS MATERIALIZED (SELECT CASE event_id % 4 WHEN 0 THEN 'di' WHEN 1 THEN 'mediatr' WHEN 2 THEN 'type' ELSE 'call' END AS kind, n_file AS file, CAST(event_id AS INTEGER) AS line, props AS expression, "
    "CASE user_id % 3 WHEN 0 THEN 'ambiguous-type-name' WHEN 1 THEN 'no-handler' ELSE 'type-outside-index' END AS reason, r_name AS project FROM events JOIN place ON user_id % 25 = n_nationkey WHERE event_type = 'error')"
)
LOG = (
    "log AS (SELECT ts, cmd, caller, ms, CAST(k * 7 AS INTEGER) AS out_tokens, CASE WHEN k < 80 THEN 0 WHEN k < 90 THEN 2 WHEN k < 95 THEN 4 ELSE 70 END AS exit, session FROM (SELECT ts, event_type AS cmd, "
    "CASE WHEN user_id % 5 = 0 THEN 'human' ELSE 'agent-' || (user_id % 3) END AS caller, CAST(trunc(value * 100) AS BIGINT) AS ms, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, 's' || user_id AS session FROM events))"
)
REFS = (
    "refs AS MATERIALIZED (SELECT DISTINCT a.r_name AS src, b.r_name AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN place a ON c_nationkey = a.n_nationkey "
    "JOIN supplier ON l_suppkey = s_suppkey JOIN place b ON s_nationkey = b.n_nationkey WHERE a.r_name < b.r_name)"
)


def expanded(name: str, target: int | str) -> str:
    """CTE (id, ord): a node and what it holds."""
    return f"{name} AS MATERIALIZED (SELECT id, min(ord) AS ord FROM (SELECT id, -1 AS ord FROM nodes WHERE id = {target} UNION ALL SELECT dst, e.ord FROM edges e JOIN nodes n ON e.src = n.id WHERE e.kind = 'TypeUse' AND n.id = {target} AND n.kind IN ('type', 'interface', 'enum')) GROUP BY id)"


def walk(seeds: str, depth: int, links: str, seen: str, backward: bool = False, rank: str = "0", prune: str = "FALSE", name: str = "found", key: bool = False) -> str:
    """CTEs of a breadth-first walk from `seeds` (id, ord[, key]) over the edges that the condition `links` lets through; `name` has all levels.

    Each level numbers its nodes by (parent's number, rank, edge). prune is a condition on edges left out below the first level."""
    at, to, k = ("dst", "src") if backward else ("src", "dst"), None, "key, " if key else ""
    at, to = at
    lk = f"{name}_l AS MATERIALIZED (SELECT e.{at} AS at, e.{to} AS to_, e.kind, e.note, e.score, e.source, {rank} AS rank, e.ord, d.kind AS dst_kind FROM edges e JOIN nodes d ON d.id = e.dst WHERE {links})"
    null = "CAST(NULL AS VARCHAR)"
    out = [lk, f"{name}_0 AS MATERIALIZED (SELECT {k}id, 0 AS level, CAST(NULL AS BIGINT) AS parent, {null} AS kind, {null} AS note, CAST(1 AS DOUBLE) AS score, {null} AS source, row_number() OVER (ORDER BY ord) AS ord FROM {seeds})"]
    known = f"SELECT {k}id FROM {seen}"
    for n in range(1, depth + 1):
        on = "s.id = c.id" + (" AND s.key = c.key" if key else "")
        step = f"SELECT {'f.key, ' if key else ''}l.to_ AS id, f.id AS parent, l.kind, l.note, least(f.score, l.score) AS score, CASE WHEN l.score < f.score THEN l.source ELSE f.source END AS source, f.ord AS po, l.rank AS ra, l.ord AS eo FROM {name}_{n - 1} f JOIN {name}_l l ON l.at = f.id{f' WHERE NOT ({prune})' if n > 2 else ''}"
        part = f"PARTITION BY {k}id ORDER BY po, ra, eo"
        out.append(f"{name}_{n} AS MATERIALIZED (SELECT {k}id, {n} AS level, parent, kind, note, score, source, row_number() OVER (ORDER BY po, ra, eo) AS ord FROM (SELECT *, row_number() OVER ({part}) AS rn FROM ({step}) c WHERE NOT EXISTS (SELECT 1 FROM ({known}) s WHERE {on})) WHERE rn = 1)")
        known += f" UNION ALL SELECT {k}id FROM {name}_{n}"
    out.append(f"{name} AS MATERIALIZED ({' UNION ALL '.join(f'SELECT * FROM {name}_{n}' for n in range(1, depth + 1))})")
    return ", ".join(out)


def mermaid(x: str) -> str:
    return f"replace({x}, '\"', '#quot;')"


def dot(x: str) -> str:
    return f"replace(replace({x}, '\\', '\\\\'), '\"', '\\\"')"
