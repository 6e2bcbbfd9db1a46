"""Traversals: one breadth-first kernel, level by level, and what is asked of it.

A level is an equi-join of the frontier with the edges, a minimum per node reached (summed up before it is shuffled) and
an anti-join with what was seen. The order of discovery is an array that each step extends by the sort keys of the edge
it took, so ties are settled as a sequential walk would settle them, without numbering rows in one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..components import connected_components
from ..functions.predicates import OWNERS, TYPES, is_flow, score
from ..graph import Graph
from ..tables import written

ROWS = "key long, id long, level int, parent long, kind string, note string, score double, source string, ord array<long>"


def seeds(df: DataFrame, id_: str = "id", key: Column | None = None, order: Column | None = None) -> DataFrame:
    """Rows of level 0; `key` tells walks that share a table apart, `order` is the place of a seed."""
    null = lambda t: F.lit(None).cast(t)
    return df.select(
        (key if key is not None else F.lit(0)).cast("long").alias("key"), F.col(id_).cast("long").alias("id"), F.lit(0).alias("level"), null("long").alias("parent"), null("string").alias("kind"), null("string").alias("note"),
        F.lit(1.0).alias("score"), null("string").alias("source"), F.array((order if order is not None else F.lit(0)).cast("long")).alias("ord"),
    )


def walk(edges: DataFrame | Sequence[DataFrame], start: DataFrame, depth: int, backward: bool = False, seen: DataFrame | None = None, rank: list[Column] | None = None, allow: Callable[[int], Column] | None = None, goals: DataFrame | None = None) -> DataFrame:
    """What is reached from `start` (rows of `seeds`) in at most `depth` steps, each node once for each key, as discovered first.

    seen: (key, id) that are not to be discovered, `start` if not given. rank: sort keys of an edge among those of a node,
    before its ord. allow: a condition on an edge (kind, note, score) by the level of its source. goals: (id) at which
    the walk stops after the level that meets one. The score of a row is the least along its path, source that of
    the weakest edge. The rows of `start` are not returned. `edges`, whole or in parts, are scanned for each level: give tables."""
    at, to = ("dst", "src") if backward else ("src", "dst")
    step = F.array(*(c.cast("long") for c in rank or []), F.col("ord").cast("long"))
    parts = [edges] if isinstance(edges, DataFrame) else list(edges)
    links = [e.select(F.col(at).alias("at"), F.col(to).alias("to"), F.col("kind").alias("k"), F.col("note").alias("t"), score().alias("s"), F.col("source").alias("f"), step.alias("step")) for e in parts]
    frontier = written(start)
    seen = (seen if seen is not None else frontier).select("key", F.col("id").alias("to"))
    found: DataFrame | None = None
    for level in range(1, depth + 1):
        ahead = frontier.select("key", F.col("id").alias("at"), "score", "source", "ord")
        near = reduce(DataFrame.unionByName, (ahead.join(part, "at") for part in links))
        if allow:
            near = near.where(allow(level - 1))
        near = near.select(
            "key", "to", F.struct(F.concat("ord", "step").alias("ord"), F.col("at").alias("parent"), F.col("k").alias("kind"), F.col("t").alias("note"), F.least("score", "s").alias("score"), F.when(F.col("s") < F.col("score"), F.col("f")).otherwise(F.col("source")).alias("source")).alias("r"),
        )
        new = near.join(seen, ["key", "to"], "left_anti").groupBy("key", "to").agg(F.min_by("r", "r.ord").alias("r"))
        new = written(new.select("key", F.col("to").alias("id"), F.lit(level).alias("level"), "r.parent", "r.kind", "r.note", "r.score", "r.source", "r.ord"))
        if new.isEmpty():
            break
        found = new if found is None else found.unionByName(new)
        seen = seen.unionByName(new.select("key", F.col("id").alias("to")))
        frontier = new
        if goals is not None and not new.join(goals, "id", "left_semi").isEmpty():
            break
    return found if found is not None else frontier.limit(0)


def one(graph: Graph, id_: int) -> DataFrame:
    return graph.nodes.where(F.col("id") == id_)


def members(graph: Graph, targets: DataFrame, notes: tuple[str, ...] | None = None) -> DataFrame:
    """(target, id, ord): what the types, interfaces and enums of `targets` hold by type use."""
    held = graph.edges.where("kind = 'TypeUse'")
    if notes:
        held = held.where(F.col("note").isin(*notes))
    own = targets.where(F.col("kind").isin(*TYPES)).select(F.col("id").alias("src"))
    return held.join(own, "src").select(F.col("src").alias("target"), F.col("dst").alias("id"), "ord")


def expand(graph: Graph, targets: DataFrame) -> DataFrame:
    """(id, ord): the targets and what the types among them hold."""
    return targets.select("id", F.lit(-1).cast("long").alias("ord")).unionByName(members(graph, targets).select("id", "ord")).groupBy("id").agg(F.min("ord").alias("ord"))


def upstream(graph: Graph) -> list[DataFrame]:
    """The edges that an impact runs along, to be walked backward."""
    return [e.where("kind <> 'TypeUse'") for e in graph.entering()]


def flow(graph: Graph) -> list[DataFrame]:
    """The edges of control flow, to be walked forward."""
    return [e.where(is_flow()) for e in graph.leaving()]


def blast_radius(graph: Graph, target: int, depth: int = 3) -> DataFrame:
    """Who would feel a change of `target`: reverse reach of it and its members, with the target itself discoverable."""
    start = seeds(expand(graph, one(graph, target)), order=F.col("ord"))
    return walk(upstream(graph), start, depth, backward=True, seen=start.where(F.col("id") != target))


def reverse_reach(graph: Graph, target: int, depth: int = 3) -> DataFrame:
    """As the blast radius, with the target counted as seen from the start."""
    start = seeds(expand(graph, one(graph, target)), order=F.col("ord"))
    return walk(upstream(graph), start, depth, backward=True)


def reverse_reach_each(graph: Graph, targets: DataFrame, depth: int = 3) -> DataFrame:
    """For each of many targets (id), its own reverse reach; key is the target."""
    nodes = graph.nodes.join(targets.select("id"), "id", "left_semi")
    start = seeds(nodes, key=F.col("id")).unionByName(seeds(members(graph, nodes), key=F.col("target"), order=F.col("ord")))
    return walk(upstream(graph), start, depth, backward=True)


def declaring_types(graph: Graph, of: DataFrame | None = None) -> DataFrame:
    """(id, owner): the type that declares a member, by its first type use as member or constructor, else the one type its name begins with; of the nodes in `of` (id), or all."""
    held = [e.where(F.col("note").isin(*OWNERS) & (F.col("kind") == "TypeUse")) for e in (graph.entering() if of is not None else (graph.edges,))]
    if of is not None:
        of = of.select("id").distinct()
        held = [e.join(of.select(F.col("id").alias("dst")), "dst", "left_semi") for e in held]
    held = reduce(DataFrame.unionByName, (e.select("src", "dst", "ord") for e in held)).groupBy(F.col("dst").alias("id")).agg(F.min_by("src", "ord").alias("owner"))
    named = graph.nodes.where(F.col("kind").isin(*TYPES)).groupBy(F.col("name").alias("prefix")).agg(F.min("id").alias("by_name"), F.count(F.lit(1)).alias("n")).where("n = 1")
    rest = graph.nodes if of is None else graph.nodes.join(of, "id", "left_semi")
    rest = rest.where(~F.col("kind").isin(*TYPES)).select("id", F.regexp_extract("name", r"^(.*)\.[^.]*$", 1).alias("prefix"))
    return rest.join(held, "id", "left").join(named, "prefix", "left").select("id", F.coalesce("owner", "by_name").alias("owner")).where("owner IS NOT NULL")


def blast_sections(graph: Graph, target: int, depth: int = 3) -> DataFrame:
    """(section, id): entrypoints reached, direct callers that are tests or not, and the types that own what is reached further on."""
    from ..functions.predicates import is_entrypoint, is_test

    reached = blast_radius(graph, target, depth).join(graph.nodes.select("id", "tags", F.col("kind").alias("node_kind")), "id")
    direct = F.col("level") == 1
    owners = reached.where(~direct).join(declaring_types(graph, reached), "id", "left")
    parts = [
        reached.where(is_entrypoint()).select(F.lit("entrypoint").alias("section"), "id"),
        reached.where(direct).select(F.when(is_test(), "direct-test").otherwise("direct").alias("section"), "id"),
        owners.select(F.lit("indirect-type").alias("section"), F.when(F.col("node_kind").isin(*TYPES), F.col("id")).otherwise(F.col("owner")).alias("id")).where("id IS NOT NULL").distinct(),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def blast_projects(graph: Graph, target: int, depth: int = 3) -> DataFrame:
    """(project, reached) of a blast radius."""
    return blast_radius(graph, target, depth).join(graph.nodes.select("id", "project"), "id").groupBy("project").agg(F.count(F.lit(1)).alias("reached"))


def direct_callers(graph: Graph, target: int) -> DataFrame:
    """(id): who uses a type or its members from outside of it, once for each key."""
    own = one(graph, target)
    inside = own.select("id").unionByName(members(graph, own, OWNERS).select("id"))
    inside = written(inside.select(F.col("id").alias("dst")))
    callers = reduce(DataFrame.unionByName, (e.where("kind <> 'TypeUse'").join(inside, "dst", "left_semi").select("src", "ord") for e in graph.entering()))
    callers = written(callers.groupBy(F.col("src").alias("id")).agg(F.min("ord").alias("ord")))
    name = own.select(F.col("name").alias("outer"))
    nodes = callers.join(graph.nodes.select("id", "key", "name", "tags"), "id").join(declaring_types(graph, callers), "id", "left")
    out = nodes.crossJoin(F.broadcast(name))  # one row
    out = out.where((F.col("id") != target) & ~F.coalesce(F.col("owner") == target, F.lit(False)) & ~F.startswith("name", F.concat("outer", F.lit("."))))
    return out.groupBy("key").agg(F.min_by(F.struct("id", "tags"), "ord").alias("r")).select("r.id", F.array_contains("r.tags", "test").alias("is_test"))


def writers(graph: Graph, target: int) -> DataFrame:
    """(id, via): who writes a member, directly or through an interface of the writer; direct ones count first."""
    from ..functions.predicates import has_write

    direct = graph.edges.where((F.col("dst") == target) & (F.col("kind") == "Call") & has_write()).select(F.col("src").alias("id"), F.lit("direct").alias("via"), F.lit(0).alias("w"))
    faces = graph.edges.where("kind = 'Interface'").select(F.col("dst").alias("id"), F.col("src").alias("face"))
    through = direct.join(faces, "id").select(F.col("face").alias("id"), F.lit("via-interface").alias("via"), F.lit(1).alias("w"))
    return direct.unionByName(through).groupBy("id").agg(F.min_by("via", "w").alias("via"))


def trace(graph: Graph, start: int, depth: int = 6) -> DataFrame:
    """The forward call tree with each node expanded once, at its least level; `ord` sorts it as a tree.

    Children stand in the order of bound, score, construction last. A type constructed below the first level is left out."""
    types = graph.nodes.where("kind = 'type'").select(F.col("id").alias("dst"), F.lit(True).alias("is_type"))
    made = graph.edges.where(is_flow() & (F.col("kind") == "Construct")).join(types, "dst", "left")
    made = written(made.withColumn("kind", F.when(F.col("is_type"), "Construct type").otherwise(F.col("kind"))).drop("is_type"))
    way = [*(e.where("kind <> 'Construct'") for e in flow(graph)), made]  # the stored edges as they are, so that their buckets serve
    rank = [F.when(F.col("note").eqNullSafe("di-bound"), 0).otherwise(1), F.round((1 - score()) * 1_000_000), F.when(F.col("kind").startswith("Construct"), 1).otherwise(0)]
    out = walk(way, seeds(one(graph, start)), depth, rank=rank, allow=lambda level: F.lit(True) if level <= 1 else F.col("k") != "Construct type")
    return out.withColumn("kind", F.when(F.col("kind") == "Construct type", "Construct").otherwise(F.col("kind")))


def depth_that_fits(costs: DataFrame, budget: int, share: float = 0.85) -> DataFrame:
    """(depth): of (level, cost) rows, the deepest level up to which all costs fit the share of the budget; at least 1."""
    from pyspark.sql import Window

    levels = costs.groupBy("level").agg(F.sum("cost").alias("cost"))  # as many rows as levels
    total = F.sum("cost").over(Window.partitionBy(F.lit(0)).orderBy("level"))
    return levels.withColumn("upto", total).where(F.col("upto") <= share * budget).agg(F.coalesce(F.max("level"), F.lit(1)).alias("depth"))


def shortest_path(graph: Graph, start: int, goal: int, depth: int = 12) -> DataFrame:
    """(hop, id, kind, note, score) of the shortest flow path from `start` or what it holds to `goal` or what that holds; hop 0 is its first node. Empty without one."""
    begin, end = expand(graph, one(graph, start)), written(expand(graph, one(graph, goal)).select("id"))
    first = seeds(begin, order=F.col("ord"))
    both = begin.join(end, "id", "left_semi").orderBy("ord").limit(1)
    meet = written(both.select(F.lit(0).alias("hop"), "id", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("note"), F.lit(1.0).alias("score")))
    if not meet.isEmpty():
        return meet
    found = walk(flow(graph), first, depth, rank=[F.round((1 - score()) * 1_000_000)], goals=end)
    hit = found.join(end, "id", "left_semi").orderBy("level", "ord").limit(1)
    rows = found.unionByName(first)
    at = written(hit.select("id", "parent", "level", "kind", "note"))
    out = at
    while not at.where("parent IS NOT NULL").isEmpty():  # a row for each hop, at most `depth`
        at = written(rows.join(at.select(F.col("parent").alias("id")), "id").select("id", "parent", "level", "kind", "note"))
        out = out.unionByName(at)
    weakest = graph.edges.select(F.col("src").alias("parent"), F.col("dst").alias("id"), "kind", score().alias("score"))
    return out.join(weakest, ["parent", "id", "kind"], "left").select(F.col("level").alias("hop"), "id", "kind", "note", F.coalesce("score", F.lit(1.0)).alias("score"))


def hops(graph: Graph, start: int, goal: int, depth: int = 12) -> DataFrame:
    """(hops): the length of the shortest flow path, 0 if there is none."""
    return shortest_path(graph, start, goal, depth).agg(F.coalesce(F.max("hop"), F.lit(0)).cast("long").alias("hops"))


def neighbourhood(graph: Graph, start: int, depth: int = 1, shown: DataFrame | None = None, direction: str = "both", type_use: bool = False) -> DataFrame:
    """(distance, within, nodes): how many nodes stand at each distance from `start`, up to whatever it reaches; `shown` (id) are the nodes there are, all if not given.

    direction: "out", "in" or "both". Only distances are kept. What was seen before is anti-joined; of a walk both ways that is
    the last two levels, as a node's neighbours are at most one level apart."""
    if direction not in ("out", "in", "both"):
        raise ValueError(f"no such direction: {direction}")
    links = [e.select(F.col(at).alias("id"), F.col(to).alias("to"), "kind") for parts, at, to, way in ((graph.leaving(), "src", "dst", "out"), (graph.entering(), "dst", "src", "in")) if direction in (way, "both") for e in parts]
    links = [(e if type_use else e.where("kind <> 'TypeUse'")).drop("kind") for e in links]
    here = lambda df: df if shown is None else df.join(shown.select("id"), "id", "left_semi")
    level = written(here(graph.nodes.where(F.col("id") == start).select("id")))
    seen, counts, distance = [level], [], 0
    while True:
        near = reduce(DataFrame.unionByName, (level.join(e, "id").select(F.col("to").alias("id")) for e in links)).distinct()
        for before in seen:
            near = near.join(before, "id", "left_anti")
        level, distance = written(here(near)), distance + 1
        n = level.count()
        if not n:
            return graph.nodes.sparkSession.createDataFrame(counts, "distance int, within boolean, nodes long")
        counts.append((distance, distance <= depth, n))
        seen = [seen[-1], level] if direction == "both" else [written(seen[0].unionByName(level))]


#: Most projects of a stretch in one row of its blocks, and pairs of projects for each partition of a closure, about.
BLOCK, PAIRS = 512, 1 << 21


def closure(refs: DataFrame) -> DataFrame:
    """(root, project): what each project reaches over its references (src, dst), over however many.

    Projects in a stretch, along which no reference enters or leaves between the ends, reach the same beyond it. So only pairs of
    stretches are found and stored; blocks of their projects meet when the rows are read, and pairs within are made there, each once."""
    refs = written(refs.select("src", "dst").distinct())
    places = _stretches(refs)
    if places is None:
        return _reach(refs).select(F.col("src").alias("root"), F.col("dst").alias("project"))
    rest = refs.join(places.where("place > 0").select(F.col("node").alias("dst")).hint("merge"), "dst", "left_anti")  # what enters a stretch, enters its head
    heads = places.select(F.col("node").alias("src"), "head").hint("merge")
    reach = _reach(rest.join(heads, "src", "left").select(F.coalesce("head", "src").alias("src"), "dst"))
    sizes = written(places.groupBy("head").agg(F.count(F.lit(1)).alias("n")))
    rings = reach.where("src = dst").select(F.col("src").alias("head")).hint("merge")
    own = sizes.join(rings, "head", "left_anti").select(F.col("head").alias("src"), F.col("head").alias("dst"), F.lit(True).alias("own"))
    pairs = reach.select("src", "dst", F.lit(False).alias("own")).unionByName(own)
    for end, n in (("src", "m"), ("dst", "n")):
        pairs = pairs.join(sizes.select(F.col("head").alias(end), F.col("n").alias(n)).hint("merge"), end, "left")
    pairs = written(pairs.select("src", "dst", "own", F.coalesce("m", F.lit(1)).alias("m"), F.coalesce("n", F.lit(1)).alias("n")))
    blocks = written(places.groupBy("head", F.floor(F.col("place") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(F.struct("place", "node"))).getField("node").alias("nodes")))
    several = "m > 1 OR n > 1"
    total = pairs.where(several).agg(F.sum(F.expr("IF(own, n * (n - 1) DIV 2, m * n)"))).first()[0]
    side = lambda end, block, nodes: blocks.select(F.col("head").alias(end), F.col("block").alias(block), F.col("nodes").alias(nodes)).hint("merge")
    met = pairs.where(several).select("src", "dst", "own", "n", F.explode(F.expr(f"sequence(0L, (m - 1) DIV {BLOCK})")).alias("b")).join(side("src", "b", "roots"), ["src", "b"], "left")
    met = met.select("src", "dst", "own", "b", "roots", F.explode(F.expr(f"sequence(IF(own, b, 0L), (n - 1) DIV {BLOCK})")).alias("c")).join(side("dst", "c", "projects"), ["dst", "c"], "left")
    met = met.repartition(-(-total // PAIRS), "src", "b", "dst", "c")
    met = met.select((F.col("own") & (F.col("b") == F.col("c"))).alias("same"), F.coalesce("projects", F.array("dst")).alias("projects"), F.posexplode(F.coalesce("roots", F.array("src"))).alias("i", "root"))
    met = met.select("root", F.explode(F.when(F.col("same"), F.slice("projects", F.col("i") + 2, BLOCK)).otherwise(F.col("projects"))).alias("project"))
    return met.unionByName(pairs.where(f"NOT ({several})").select(F.col("src").alias("root"), F.col("dst").alias("project")))


def _stretches(refs: DataFrame) -> DataFrame | None:
    """(node, head, place): where projects stand in stretches of two or more, from their heads (place 0) on, or None where there are no stretches.

    Of a reference within, neither has the source another way out nor the target another way in. A ring by itself begins at its least project."""
    only = lambda end: refs.groupBy(end).agg(F.count(F.lit(1)).alias("n")).where("n = 1").select(end).hint("merge")
    links = written(refs.where("src <> dst").join(only("src"), "src", "left_semi").join(only("dst"), "dst", "left_semi"))
    if links.isEmpty():
        return None
    places, rings = _placed(links)
    if rings is not None:
        rings = written(links.join(rings.select(F.col("node").alias("dst")).hint("merge"), "dst", "left_semi"))
        first = connected_components(rings.select(F.col("src").alias("a"), F.col("dst").alias("b"))).select(F.col("component").alias("dst")).distinct()
        places = places.unionByName(_placed(rings.join(first.hint("merge"), "dst", "left_anti"))[0])
    return written(places.unionByName(places.select(F.col("head").alias("node"), "head", F.lit(0).cast("long").alias("place")).distinct()))


def _placed(links: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(node, head, place) of the targets of links (src, dst) that have a head, and those in rings, if any: each looks from where it stands to where that looks, twice as far each round."""
    at = written(links.select(F.col("dst").alias("node"), F.col("src").alias("head"), F.lit(1).cast("long").alias("place"), F.lit(False).alias("done")))
    before, left = None, at.count()
    while left and left != before:  # while any has a head, one of them gets there each round
        ahead = at.select(F.col("node").alias("head"), F.col("head").alias("to"), F.col("place").alias("more"), F.col("done").alias("ends"))
        on = at.where("NOT done").join(ahead.hint("merge"), "head", "left")
        on = on.select("node", F.coalesce("to", "head").alias("head"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"), F.coalesce("ends", F.lit(True)).alias("done"))
        at = written(on.unionByName(at.where("done")))
        before, left = left, at.where("NOT done").count()
    return at.where("done").drop("done"), at.where("NOT done") if left else None


def _reach(jumps: DataFrame) -> DataFrame:
    """(src, dst): each pair of which the first reaches the second over references (src, dst), once each.

    The ways that are shorter than 2^k are lengthened by those whose shortest length is just 2^k, so a pair that is
    this far on is met once for each shortest way between two, not once for each project on the way."""
    jumps = written(jumps)
    found = jumps.limit(0)
    while not jumps.isEmpty():  # without a pair at 2^k none is further apart
        ahead = jumps.select(F.col("src").alias("via"), "dst").hint("merge")
        over = lambda ways, double: ways.select("src", F.col("dst").alias("via")).join(ahead, "via").select("src", "dst", F.lit(double).alias("double"))
        near = found.unionByName(jumps)
        new = written(_unmet(over(found, False).unionByName(over(jumps, True)), near))
        found, jumps = near.unionByName(new.where("NOT double").drop("double")), new.where("double").drop("double")
    return found


def _unmet(pairs: DataFrame, met: DataFrame) -> DataFrame:
    """The pairs (src, dst, double), each once, that aren't among those met (too many to broadcast, however small their files); double if each of their ways is."""
    return pairs.groupBy("src", "dst").agg(F.min("double").alias("double")).join(met.hint("merge"), ["src", "dst"], "left_anti")


def scope(refs: DataFrame, roots: DataFrame, solution: DataFrame | None = None) -> DataFrame:
    """(project): the projects in scope: those that a solution lists (project), if there is one, else the roots (project) and what they refer to."""
    if solution is not None:
        return solution.select("project").distinct()
    reached = closure(refs).join(roots.select(F.col("project").alias("root")), "root", "left_semi").select("project")
    return roots.select("project").unionByName(reached).distinct()


#: Most references among projects that are walked on the driver.
MOST_REFERENCES = 1_000_000


def project_depths(projects: DataFrame, refs: DataFrame) -> DataFrame:
    """(project, depth): the length of the longest chain of references below each project.

    Projects don't refer in cycles as a rule, and then depths are raised until none grows. If they do, a reference to a project that a walk in
    the order of names is still below ends the chain there (it counts one); that is a matter of order, so the walk runs on the driver."""
    refs = written(refs.select("src", "dst").distinct())
    depth = written(projects.select("project").distinct().select("project", F.lit(0).alias("depth")))
    rounds = 0
    while True:
        rounds += 1
        if rounds == 64 and not _acyclic(refs):  # so long a chain, or depths that rise without end
            break
        below = refs.join(depth.select(F.col("project").alias("dst"), F.col("depth").alias("d")), "dst").groupBy(F.col("src").alias("project")).agg((F.max("d") + 1).alias("d"))
        grown = written(depth.join(below, "project", "left").select("project", F.greatest("depth", F.coalesce("d", F.lit(0))).alias("depth"), (F.col("d") > F.col("depth")).alias("grew")))
        depth = grown.select("project", "depth")
        if grown.where("grew").isEmpty():
            return depth
    rows = refs.limit(MOST_REFERENCES + 1).collect()
    if len(rows) > MOST_REFERENCES:
        raise ValueError(f"references in cycles, and more than {MOST_REFERENCES} of them")
    names = [r["project"] for r in projects.select("project").distinct().limit(MOST_REFERENCES + 1).collect()]
    if len(names) > MOST_REFERENCES:
        raise ValueError(f"references in cycles, and more than {MOST_REFERENCES} projects")
    return projects.sparkSession.createDataFrame(sorted(chains(names, [(r["src"], r["dst"]) for r in rows]).items()), "project string, depth int")


def _acyclic(refs: DataFrame) -> bool:
    from .structure import components

    loops = refs.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return loops.where("a = b").isEmpty() and components(loops).isEmpty()


def chains(names: list[str], refs: list[tuple[str, str]]) -> dict[str, int]:
    """The longest chain below each project, by a walk in the order of names; a project that the walk stands below counts as a last one."""
    below: dict[str, list[str]] = {}
    for s, d in sorted(refs):
        below.setdefault(s, []).append(d)
    depth: dict[str, int] = {}
    for name in sorted(names):
        stack, deepest = ([(name, iter(below.get(name, ())))], [0]) if name not in depth else ([], [])
        path = {name}
        while stack:
            project, rest = stack[-1]
            d = next(rest, None)
            if d is None:
                stack.pop()
                path.discard(project)
                depth[project] = deepest.pop()
                if deepest:
                    deepest[-1] = max(deepest[-1], depth[project] + 1)
            elif d in depth or d in path:
                deepest[-1] = max(deepest[-1], depth.get(d, 0) + 1)
            else:
                path.add(d)
                stack.append((d, iter(below.get(d, ()))))
                deepest.append(0)
    return {n: depth[n] for n in names}


def build_order(projects: list[str], refs: list[tuple[str, str]]) -> tuple[list[str], list[tuple[str, str]]]:
    """An order in which each project follows those it refers to, smallest name first, and the references dropped to break cycles. Projects are few: this runs on the driver."""
    waits = {p: {d for s, d in refs if s == p and d != p and d in projects} for p in projects}
    out, dropped = [], []
    while waits:
        ready = sorted(p for p, w in waits.items() if not w)
        if not ready:
            p = min(waits)
            d = min(waits[p])
            waits[p].discard(d)
            dropped.append((p, d))
            continue
        out.append(ready[0])
        del waits[ready[0]]
        for w in waits.values():
            w.discard(ready[0])
    return out, dropped
