"""Operators on small graphs made by hand."""

import random

import pytest
from pyspark.sql import functions as F

from strandgraph.functions import present
from strandgraph.graph import EDGES, NODES, Graph
from strandgraph.operators import bind, compare, explain, rank, resolve, structure, walk


def graph(spark, nodes, edges, **more):
    """nodes: (id, short, kind, file, line, end_line, tags); edges: (src, dst, kind, note, confidence, role)."""
    n = [(i, f"{k}|{s}", f"N.{s}", s, k, f, a, b, f"{s}()", "p", list(t)) for i, s, k, f, a, b, t in nodes]
    e = [(a, b, k, t, c, None, None, r, o) for o, (a, b, k, t, c, r) in enumerate(edges)]
    return Graph(spark.createDataFrame(n, NODES), spark.createDataFrame(e, EDGES), **more)


def node(i, short=None, kind="method", file="", line=0, end=0, tags=()):
    return (i, short or f"T{i}.m", kind, file, line, end, tags)


def call(a, b, kind="Call", note=None, confidence=None, role=None):
    return (a, b, kind, note, confidence, role)


@pytest.mark.parametrize("seed", range(3))
def test_reverse_walk_is_the_sequential_walk(spark, seed):
    r = random.Random(seed)
    edges = list({(a, b, k): (a, b, k, None, r.choice([None, 0.5, 0.7, 0.9]), None) for a, b, k in ((r.randrange(9), r.randrange(9), r.choice(["Call", "Mediatr", "TypeUse"])) for _ in range(40)) if a != b}.values())
    g = graph(spark, [node(i, kind="type" if i == 0 else "method") for i in range(9)], edges)
    start = [0] + [b for a, b, k, *_ in edges if a == 0 and k == "TypeUse"]
    seen, rows, queue = set(start) - {0}, [], [(i, 0, 1.0) for i in dict.fromkeys(start)]
    while queue:
        at, level, score = queue.pop(0)
        if level < 3:
            for a, b, k, _, c, _ in edges:
                if b == at and k != "TypeUse" and a not in seen:
                    seen.add(a)
                    s = min(score, 1.0 if c is None else c)
                    rows.append((a, level + 1, s))
                    queue.append((a, level + 1, s))
    got = walk.blast_radius(g, 0).orderBy("level", "ord").select("id", "level", "score").collect()
    assert [tuple(x) for x in got] == rows


def test_shortest_path(spark):
    g = graph(spark, [node(i) for i in range(6)], [call(0, 1), call(1, 2, confidence=0.5), call(0, 3), call(3, 2), call(2, 4), call(4, 0), call(2, 5, "Call", "prop")])
    assert [tuple(r) for r in walk.shortest_path(g, 0, 4).orderBy("hop").select("hop", "id", "score").collect()] == [(0, 0, 1.0), (1, 1, 1.0), (2, 2, 0.5), (3, 4, 1.0)]
    assert walk.shortest_path(g, 0, 5).count() == 0
    assert walk.shortest_path(g, 3, 3).select("id").collect()[0][0] == 3
    assert walk.hops(g, 0, 4).first()[0] == 3


def test_trace_leaves_out_constructed_types(spark):
    g = graph(spark, [node(0), node(1), node(2), node(3, "T", "type"), node(4, "U", "type")], [call(0, 1), call(0, 3, "Construct"), call(1, 2), call(2, 4, "Construct"), call(1, 4, "Interface", "di-bound")])
    assert [(r["id"], r["level"]) for r in walk.trace(g, 0).orderBy("ord").collect()] == [(1, 1), (4, 2), (2, 2), (3, 1)]


def test_writers_and_callers(spark):
    g = graph(
        spark, [node(0, "T", "type"), node(1, "T.f", "field"), node(2, "U.w"), node(3, "U.r"), node(4, "I.w", "interface"), node(5, "T.own")],
        [call(0, 1, "TypeUse", "member"), call(0, 5, "TypeUse", "member"), call(2, 1, role=2), call(3, 1, role=1), call(4, 2, "Interface"), call(5, 1, role=3)],
    )
    assert sorted(tuple(r) for r in walk.writers(g, 1).collect()) == [(2, "direct"), (4, "via-interface"), (5, "direct")]
    assert sorted(r["id"] for r in walk.direct_callers(g, 0).collect()) == [2, 3]


@pytest.mark.parametrize("seed", range(4))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = {(r.randrange(14), r.randrange(14)) for _ in range(24)}
    reach = {n: {n} for n in range(14)}
    for _ in range(14):
        for a, b in edges:
            for n in reach:
                if a in reach[n]:
                    reach[n].add(b)
    want = {}
    for n in range(14):
        c = [m for m in reach[n] if n in reach[m]]
        if len(c) > 1:
            want[n] = min(c)
    df = spark.createDataFrame(sorted(edges), "a long, b long")
    assert {x["node"]: x["component"] for x in structure.components(df).collect()} == want


def test_components_of_long_rings_and_tails(spark):
    ring = [(k, (k + 1) % 400) for k in range(400)]
    tail = [(400 + k, 401 + k) for k in range(150)] + [(550, 7)] + [(9, 1000)] + [(1000 + k, 1001 + k) for k in range(90)]
    two = [(2000, 2001), (2001, 2000), (3000, 3000), (3000, 3001), (4000, 4001), (4001, 4002), (4002, 4001), (4002, 4003), (4003, 4000)]
    df = spark.createDataFrame(ring + tail + two, "a long, b long")
    got = {x["node"]: x["component"] for x in structure.components(df).collect()}
    assert got == {**{k: 0 for k in range(400)}, 2000: 2000, 2001: 2000, **{k: 4000 for k in range(4000, 4004)}}


@pytest.mark.parametrize("seed", range(3))
def test_components_with_chains(spark, seed):
    r = random.Random(seed + 50)
    core = [(r.randrange(8), r.randrange(8)) for _ in range(12)]
    edges, new = set(), 100
    for a, b in core:  # each edge drawn out to a chain
        at = a
        for _ in range(r.randrange(4)):
            edges.add((at, new))
            at, new = new, new + 1
        edges.add((at, b))
    nodes = sorted({n for e in edges for n in e})
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in edges:
            reach[a] |= reach[b]
    want = {n: min(m for m in reach[n] if n in reach[m]) for n in nodes if any(n in reach[m] for m in reach[n] - {n})}
    got = {x["node"]: x["component"] for x in structure.components(spark.createDataFrame(sorted(edges), "a long, b long")).collect()}
    assert got == want


def test_closure_and_depths_have_no_last_round(spark):
    chain = spark.createDataFrame([(f"p{k:03}", f"p{k + 1:03}") for k in range(70)], "src string, dst string")
    assert walk.closure(chain).count() == 71 * 70 // 2
    names = spark.createDataFrame([(f"p{k:03}",) for k in range(71)], "project string")
    got = {r["project"]: r["depth"] for r in walk.project_depths(names, chain).collect()}
    assert got == {f"p{k:03}": 70 - k for k in range(71)}


def test_depths_of_projects_that_refer_in_cycles(spark):
    refs = [("a", "b"), ("b", "a"), ("c", "a"), ("b", "d"), ("d", "e"), ("x", "x")]

    def sequential():
        known = {}

        def of(p, path):
            if p in known:
                return known[p]
            if p in path:
                return 0
            known[p] = max([of(d, path | {p}) + 1 for s, d in sorted(refs) if s == p], default=0)
            return known[p]

        return {p: of(p, frozenset()) for p in "abcdex"}

    names = spark.createDataFrame([(p,) for p in "abcdex"], "project string")
    got = {r["project"]: r["depth"] for r in walk.project_depths(names, spark.createDataFrame(refs, "src string, dst string")).collect()}
    assert got == sequential() == {"a": 3, "b": 2, "c": 4, "d": 1, "e": 0, "x": 1}


def test_neighbourhood_of_a_long_chain(spark):
    g = graph(spark, [node(k) for k in range(76)], [call(k, k + 1) for k in range(75)] + [call(5, 2, "TypeUse")])
    for way, start, want in (("out", 7, 68), ("in", 7, 7), ("both", 60, 60)):
        got = {r["distance"]: (r["within"], r["nodes"]) for r in walk.neighbourhood(g, start, 3, direction=way).collect()}
        assert len(got) == want and got[3] == (True, 2 if way == "both" else 1) and got[4][0] is False
    assert walk.neighbourhood(g, 10, shown=g.nodes.where("id BETWEEN 8 AND 12")).agg(F.sum("nodes")).first()[0] == 4
    assert walk.neighbourhood(g, 10, shown=g.nodes.where("id <> 10")).count() == 0


def test_review_says_what_it_can_not_see(spark):
    g = graph(spark, [node(1), node(2)], [call(1, 2, "Interface")])
    dated = graph(spark, [node(1), node(2)], [], meta=spark.createDataFrame([("abc12",)], "built_from_commit string"))
    none = spark.createDataFrame([], "id string")
    assert compare.review(g, dated, none, "ABC1234")[0] == 5
    for now, head in ((g, "abc12"), (dated, "abd")):
        with pytest.raises(compare.IndexGap):
            compare.review(g, now, none, head)
    changed = spark.createDataFrame([(f"p{k}.csproj",) for k in range(7)] + [("a.cs",)], "path string")
    assert compare.reference_warning(changed).startswith("reference inputs changed: p0.csproj, p1.csproj, p2.csproj, p3.csproj, p4.csproj (+2 more)")
    assert compare.reference_warning(changed.where("path = 'a.cs'")) is None


def test_loop_order_and_depth(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "d"), ("d", "a")], "a string, b string")
    assert structure.shortest_loop(edges, "a") == ["a", "b", "c", "a"]
    assert structure.shortest_loop(edges.where("a <> 'b'"), "a") == []
    order, dropped = walk.build_order(["a", "b", "c"], [("a", "b"), ("b", "c"), ("c", "a")])
    assert dropped == [("a", "b")] and order.index("a") < order.index("c") < order.index("b")


def test_stable_ids_grow_on_collision(spark):
    names = spark.createDataFrame([(f"n{k}",) for k in range(40)], "name string")
    got = {r["name"]: r["id"] for r in structure.stable_ids(names, "x_", 1).collect()}
    assert len(set(got.values())) == 40 and {len(v) for v in got.values()} <= {3, 7, 11}


def test_selectors():
    c = [(1, "T.M", "T.M(System.Int32, A.X)"), (2, "T.M", "T.M(System.Int32, B.X)"), (3, "T.M", "T.M(ref System.String)"), (4, "T.M", "T.M(List<System.Int32?>, (int, string)[])")]
    pick = lambda *p: resolve.select_overloads([(i, s) for i, _, s in c], list(p))
    assert pick("int", "A.X") == [1] and pick("int", "X") == [1, 2] and pick("string") == [] and pick("ref string") == [3]
    assert resolve.select_overloads([(1, "T.M(System.SByte, System.UIntPtr)")], ["sbyte", "nuint"]) == [1]
    assert pick("List<int>", "(Int32, String)[]") == [4]
    assert resolve.selectors(c)[1] == "T.M(System.Int32, A.X)" and resolve.selectors(c)[2] == "T.M(System.Int32, B.X)" and resolve.selectors(c)[3] == "T.M(String)"
    assert resolve.parse_selector(" T.M( int , Dictionary<string,int> ) ") == ("T.M", ["int", "Dictionary<string,int>"])


def test_single(spark):
    g = graph(spark, [node(1, "T.Run"), node(2, "U.Run"), node(3, "U.Stop")], [])
    assert resolve.single(g, "u.stop") == 3 and resolve.single(g, "T.Run()") == 1
    with pytest.raises(resolve.Ambiguous):
        resolve.single(g, "Run")
    with pytest.raises(resolve.NotFound):
        resolve.single(g, "Gone")


def test_suggestions_and_demotion(spark):
    g = graph(spark, [node(1, "Store.DeleteAsync"), node(2, "Writer.DeleteAsync"), node(3, "Store.Credential", "type"), node(4, "E.Delete", "enum-member")], [])
    ask = spark.createDataFrame([("Store.DeleteCredentialAsync",), ("Crednetial",)], "q string")
    got = {}
    for r in resolve.suggest(g, ask).orderBy("q", F.desc("score")).collect():
        got.setdefault(r["q"], []).append((r["id"], r["why"]))
    assert got["Store.DeleteCredentialAsync"][0] == (1, "same type") and got["Crednetial"] == [(3, "typo")]
    top = resolve.where(g, ["store"]).collect()
    assert {r["id"] for r in top} == {1, 3}


def test_changes_and_gate(spark):
    nodes = [node(i, f"T{i}", "type") for i in range(4)]
    before = graph(spark, nodes, [call(0, 1, "DiBinding", "scoped"), call(0, 2, "Interface", None, 0.9), call(1, 2), call(2, 3, "Mediatr")])
    now = graph(spark, nodes, [call(0, 1, "DiBinding", "singleton"), call(0, 2, "Interface", None, 0.8), call(2, 3, "Mediatr")])
    found = compare.changes(compare.facts(before), compare.facts(now))
    assert sorted((r["relation"], r["kind"]) for r in found.collect()) == [("added", "DiBinding"), ("degraded", "Interface"), ("removed", "DiBinding")]
    assert [(r["was"], r["becomes"]) for r in compare.lifetime_shifts(found).collect()] == [("scoped", "singleton")]
    assert compare.lost_wiring(found).count() == 0
    none = spark.createDataFrame([], "id string")
    assert compare.review(before, now, none)[0] == 5 and compare.review(before, now, found.select("id"))[0] == 0
    meta = spark.createDataFrame([("abc",)], "built_from_commit string")
    with pytest.raises(compare.IndexGap):
        compare.review(before, Graph(now.nodes, now.edges, meta=meta), none, head="def")


def test_covering_takes_the_innermost(spark):
    g = graph(spark, [node(1, "T", "type", "a.cs", 1, 500), node(2, "T.m", "method", "A.cs", 10, 20), node(3, "T.n", "type", "a.cs", 10, 20), node(4, "X", "type", "a.cs", 1, 2_000_000)], [])
    lines = spark.createDataFrame([("a.cs", 15), ("a.cs", 130), ("a.cs", 900), ("b.cs", 1)], "file string, line long")
    assert {(r["line"], r["id"]) for r in compare.covering(g, lines).collect()} == {(15, 2), (130, 1), (900, 4)}


def test_silence(spark):
    sites = spark.createDataFrame([("di", "a.cs", 5, "Add<Foo>", "r1"), ("di", "a.cs", 50, "Use<Face>", "r2")], "kind string, file string, line int, expression string, reason string")
    outside = spark.createDataFrame([("Ext", "asm", ["a.cs:6", "b.cs:1"])], "name string, assembly string, sites array<string>")
    g = graph(spark, [node(1, "X.Face", "interface", "a.cs", 1, 9), node(2, "X.m", "method", "b.cs", 1, 2)], [call(2, 1)], unresolved=sites, external_types=outside)
    got = {(r["kind"], r["reason"], r["n"]) for r in explain.reasons(g, g.nodes.where("id = 1")).collect()}
    assert got == {("di", "r1", 1), ("interface", "no-implementation", 1), ("external-type", "Ext", 1)}
    assert [r["line"] for r in explain.mentions(g, 1).collect()] == [50]
    assert [tuple(r) for r in explain.silence(g, 1).collect()] == [(0, 1, 3)]
    assert [r["id"] for r in explain.dead_ends(g, 2).collect()] == [1]


def test_patch_keeps_ids(spark):
    g = graph(spark, [node(1, "A", file="a.cs"), node(2, "B", file="b.cs"), node(3, "C", file="A.cs")], [call(2, 1), call(2, 3), call(1, 2)])
    new = g.nodes.where("id = 1").unionByName(g.nodes.where("id = 2").withColumns({"key": F.lit("method|D"), "file": F.lit("a.cs")}))
    edges = g.edges.limit(1).select(F.lit("method|D").alias("src_key"), F.lit("method|B").alias("dst_key"), "kind", "note", "confidence", "source", "site", "role", "ord")
    out = bind.patch(g, spark.createDataFrame([("a.cs",)], "file string"), new, edges)
    assert sorted((r["id"], r["key"]) for r in out.nodes.collect()) == [(1, "method|A"), (2, "method|B"), (4, "method|D")]
    assert sorted((r["src"], r["dst"]) for r in out.edges.collect()) == [(2, 1), (4, 2)]


def test_budget(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 4), ("a", 3, 1), ("b", 1, 3)], "g string, o int, c int")
    got = rank.within_budget(rows, F.col("c"), [F.col("o")], 9, ["g"]).collect()
    assert sorted((r["g"], r["o"], r["cut"]) for r in got) == [("a", 1, True), ("a", 2, True), ("b", 1, False)]


def test_missing(spark):
    outside = spark.createDataFrame([("HttpClient", "System.Net.Http", ["a.cs:1"])], "name string, assembly string, sites array<string>")
    g = graph(spark, [node(1, "Store.DeleteAsync")], [], external_types=outside)
    ask = spark.createDataFrame([(x,) for x in ("X.HttpClient", "A:B", "DeleteCredentialAsync", "System.Net", "zzz")], "q string")
    got = {r["q"]: (r["answer"], r["text"], r["id"]) for r in resolve.missing(g, ask).collect()}
    assert got == {"X.HttpClient": ("external", "System.Net.Http", None), "A:B": ("configuration-key", "", None), "DeleteCredentialAsync": ("suggestion", "contains", 1), "System.Net": ("package", "", None), "zzz": ("nothing", "", None)}


def test_answers(spark):
    g = graph(spark, [node(1, "T", "type", "a.cs", 3, 9, ("handler", "odd", "http:GET /x")), node(2, "T.m", "method")], [call(1, 2, "Interface", "di-bound", 0.9), call(2, 1), call(1, 2, "Mediatr", "via Send(X)"), call(1, 2, "DiBinding", "scoped"), call(1, 2, "Construct", None, 0.5)])
    assert [r[0] for r in g.edges.orderBy("ord").select(present.mark()).collect()] == ["[impl, di-bound ?0.90]", "", "[mediatr via Send(X)]", "[di:scoped]", "[new ?0.50]"]
    assert [r[0] for r in g.edges.orderBy("ord").select(present.relation()).collect()] == ["impl", "call", "mediatr", "di", "new"]
    rows = {r["id"]: r for r in present.answer(g.nodes, spark.createDataFrame([("A.cs",)], "file string")).collect()}
    assert rows[1]["stale"] and rows[1]["end_line"] == 9 and not rows[2]["stale"] and rows[2]["file"] is None and rows[2]["tags"] is None
    assert [tuple(r) for r in g.nodes.orderBy("id").select(present.place(), F.array_join(present.shown_tags(), " ")).collect()] == [("a.cs:3-9", "handler http:GET /x"), ("", "")]
    assert spark.range(1).select(present.remedy(F.lit("no-handler")), present.remedy(F.lit("?"))).first()[1] == "open the file to see"


def test_hubs_stand_apart(spark, monkeypatch):
    from strandgraph import graph as module

    monkeypatch.setattr(module, "LEAST_HUB", 5)
    plain = graph(spark, [node(i) for i in range(40)], [call(i, 0) for i in range(1, 30)] + [call(i, i - 1) for i in range(2, 40)])
    g = plain.stored(2)
    assert len(g.by_dst) == 2 and len(g.by_src) == 1 and {r["dst"] for r in g.by_dst[1].select("dst").collect()} == {0}
    rows = lambda x: sorted((r["id"], r["level"]) for r in walk.blast_radius(x, 0, 4).collect())
    assert rows(g) == rows(plain) and len(rows(g)) == 32  # 29 next to the hub, and three along the chain


def test_closure_meets_each_pair_once(spark, monkeypatch):
    met, plain = [], walk._unmet
    monkeypatch.setattr(walk, "_unmet", lambda pairs, known: met.append(pairs.count()) or plain(pairs, known))
    chain = spark.createDataFrame([(k, k + 1) for k in range(70)], "src long, dst long")
    assert walk.closure(chain).distinct().count() == 71 * 70 // 2 and sum(met) <= 71 * 70 // 2


def test_closure_of_any_references(spark):
    r = random.Random(4)
    for n, m in ((1, 1), (9, 12), (12, 40), (30, 33)):
        refs = {(str(r.randrange(n)), str(r.randrange(n))) for _ in range(m)}
        want, more = set(refs), True
        while more:
            more = {(a, d) for a, b in want for c, d in refs if b == c} - want
            want |= more
        got = [tuple(x) for x in walk.closure(spark.createDataFrame(sorted(refs) * 2, "src string, dst string")).collect()]
        assert sorted(got) == sorted(want)
    assert walk.closure(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_closure_stores_no_pairs_of_a_stretch(spark, monkeypatch):
    rows, plain = [], walk.written
    monkeypatch.setattr(walk, "written", lambda df: rows.append((x := plain(df)).count()) or x)
    names = random.Random(5).sample(range(9000), 301)
    chain = spark.createDataFrame(list(zip(names, names[1:])), "src long, dst long")
    got = walk.closure(chain)
    assert max(rows) <= 301
    place = {n: k for k, n in enumerate(names)}
    found = [(place[a], place[b]) for a, b in got.collect()]
    assert len(found) == len(set(found)) == 301 * 300 // 2 and all(a < b for a, b in found)


def test_closure_of_stretches_in_blocks(spark, monkeypatch):
    """Stretches that fork, meet, close and lead into rings, in blocks smaller than they are, against plain loops."""
    monkeypatch.setattr(walk, "BLOCK", 3)
    monkeypatch.setattr(walk, "PAIRS", 20)
    chain = lambda *names: list(zip(names, names[1:]))
    refs = set(chain(*range(9)) + chain(8, *range(30, 37), 60) + chain(8, *range(40, 44), 60, 61, 62) + chain(*range(70, 77), 70) + chain(80, 81, 80))
    refs |= set(chain(90, 91, 92, 93, 94, 95, 92) + chain(100, 101, 102, 102) + chain(102, 103, 104, 105, 106) + [(110, 110)])
    want, more = set(refs), True
    while more:
        more = {(a, d) for a, b in want for c, d in refs if b == c} - want
        want |= more
    got = [tuple(x) for x in walk.closure(spark.createDataFrame(sorted(refs) * 2, "src long, dst long")).collect()]
    assert sorted(got) == sorted(want)


def test_points_in_spans(spark):
    """Each point is counted for the spans around it, and wide spans meet sums instead of points."""
    r = random.Random(8)
    spans = [(k, r.choice("ab"), a := r.choice([0, 1, r.randrange(300), -5]), a + r.choice([0, 0, 1, 63, 98, 2_000_000_000])) for k in range(150)] + [(900, "a", None, 3), (901, None, 1, 3), (902, "a", -(1 << 31), (1 << 31) - 1)]
    points = [(r.choice("abc"), r.choice([r.randrange(-9, 400), (1 << 31) - 1, -(1 << 31)]), r.choice("xy")) for _ in range(400)] + [("a", None, "x"), (None, 2, "x")]
    want = {}
    for i, f, a, b in spans:
        for g, at, kind in points:
            if None not in (f, g, a, at) and f == g and a <= at <= b:
                want[i, kind] = want.get((i, kind), 0) + 1
    held = spark.createDataFrame(spans, "id long, f string, line int, last int")
    got = explain._counted_within(held, spark.createDataFrame(points, "f string, at int, kind string"), ("kind",))
    assert {(x["id"], x["kind"]): x["n"] for x in got.collect()} == want
    most = held.select(F.size(explain._pieces(F.col("line"), F.col("last"))).alias("n")).agg(F.max("n")).first()[0]
    assert most <= 62
