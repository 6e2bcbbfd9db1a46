"""From text to nodes: the cascade of name matches, overload selectors, suggestions, and the ranked search.

Questions are few (typed by someone), so they are broadcast; nodes are scanned once for all of them."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import is_entrypoint, is_test, leaf, owner
from ..functions.text import identifier_tokens, question_kind
from ..graph import Graph
from ..tables import written
from . import walk

#: Most questions that are asked together, and so the bound of what is broadcast.
QUESTIONS = 10_000


class NotFound(LookupError):
    """No node answers to the name."""


class Ambiguous(LookupError):
    """Several nodes answer to the name; `candidates` has at most 12 of them."""

    def __init__(self, name: str, candidates: list):
        super().__init__(f"{name} names {len(candidates)} nodes or more")
        self.candidates = candidates


def asked(questions: DataFrame) -> DataFrame:
    if questions.limit(QUESTIONS + 1).count() > QUESTIONS:
        raise ValueError(f"more than {QUESTIONS} questions at once")
    return F.broadcast(questions)


def resolve(graph: Graph, questions: DataFrame, most: int = 40) -> DataFrame:
    """(q, tier, id) of the first tier that any node meets: 1 the name, 2 the short name, 3 the end of either, 4 a member of a nested type, 5 part of the short name (at most `most`, by id).

    Whole names, ends at a dot and last parts are keys of joins. Parts of a name are looked for only for questions that have
    found nothing else: by three letters that they begin with, and one by one where they are shorter."""
    q = asked(questions.select("q").distinct().select("q", F.lower("q").alias("l")))
    nodes = graph.nodes.select("id", F.lower("name").alias("name"), F.lower("short").alias("short"))
    parts = lambda c: F.split(c, r"\.")
    ends = lambda c: F.transform(F.sequence(F.lit(2), F.size(parts(c))), lambda k: F.array_join(F.slice(parts(c), k, F.size(parts(c))), "."))
    ends_of = lambda c: F.when(F.size(parts(c)) > 1, ends(c)).otherwise(F.array().cast("array<string>"))
    key = lambda tier, text: F.struct(F.lit(tier).alias("tier"), text.alias("l"))
    keys = F.concat(F.array(key(1, F.col("name")), key(2, F.col("short"))), F.transform(F.array_union(ends_of(F.col("name")), ends_of(F.col("short"))), lambda x: key(3, x)))
    met = nodes.select("id", F.inline(keys)).join(q, "l").select("q", "tier", "id")
    dotted = q.where(owner(F.col("l")) != "").select("q", leaf("l").alias("last"), F.concat(F.lit("."), owner("l"), F.lit(".")).alias("of"))
    nested = nodes.where(F.contains("name", F.lit("."))).withColumn("last", leaf("name")).join(F.broadcast(dotted), "last").where(F.contains("name", F.col("of")))  # as few as the questions
    met = written(met.unionByName(nested.select("q", F.lit(4).alias("tier"), "id")).distinct())
    rest = q.join(met.select("q").distinct(), "q", "left_anti")
    long = F.broadcast(rest.where(F.length("l") >= 3).withColumn("gram", F.substring("l", 1, 3)))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("short") - 2), lambda k: F.substring(F.col("short"), k, F.lit(3))))
    inside = nodes.where(F.length("short") >= 3).select("id", "short", F.explode(grams).alias("gram")).join(long, "gram").where(F.contains("short", F.col("l"))).select("q", "id")
    brief = nodes.crossJoin(F.broadcast(rest.where(F.length("l") < 3))).where(F.contains("short", F.col("l"))).select("q", "id")
    met = met.unionByName(inside.unionByName(brief).select("q", F.lit(5).alias("tier"), "id"))
    first = met.groupBy("q").agg(F.min("tier").alias("tier"))
    best = met.select("q", "tier", "id").join(F.broadcast(first), ["q", "tier"])  # a row for each question at most
    place = F.row_number().over(Window.partitionBy("q").orderBy("id"))
    return best.withColumn("place", F.when(F.col("tier") == 5, place).otherwise(1)).where(F.col("place") <= most).select("q", "tier", "id")


#: Names that a keyword and a library type share.
ALIASES = {
    "object": "Object", "bool": "Boolean", "char": "Char", "sbyte": "SByte",
    "byte": "Byte", "short": "Int16", "ushort": "UInt16", "int": "Int32",
    "uint": "UInt32", "long": "Int64", "ulong": "UInt64", "decimal": "Decimal",
    "float": "Single", "double": "Double", "string": "String", "void": "Void",
    "nint": "IntPtr", "nuint": "UIntPtr",
}


def split_parameters(text: str) -> list[str]:
    """The parts between the commas outside of brackets."""
    out, depth, at = [], 0, 0
    for k, c in enumerate(text):
        depth += (c in "<([") - (c in ">)]")
        if c == "," and not depth:
            out.append(text[at:k].strip())
            at = k + 1
    return [*out, text[at:].strip()] if text.strip() else []


def parse_selector(text: str) -> tuple[str, list[str] | None]:
    """Name and parameters of `Type.Member(int, string)`; None for parameters that aren't given."""
    m = re.fullmatch(r"\s*([^()]+?)\s*(?:\((.*)\))?\s*", text, re.S)
    if not m:
        raise ValueError(f"not a selector: {text}")
    return m[1], None if m[2] is None else split_parameters(m[2])


def parameter_matches(given: str, declared: str, lenient: bool) -> bool:
    """Whether a parameter answers to what was asked: modifiers as they are, generic arguments one by one, and a dotted end of the name or its alias."""
    take = lambda s: (re.match(r"(?:(ref|out|in)\s+)?(.*)", s.strip(), re.S)[1], re.match(r"(?:(?:ref|out|in)\s+)?(.*)", s.strip(), re.S)[1])
    (m1, a), (m2, b) = take(given), take(declared)
    if m1 != m2:
        return False
    if lenient:
        a, b = a.rstrip("?"), b.rstrip("?")
    for mark in ("?", "[]"):
        if a.endswith(mark) != b.endswith(mark):
            return False
        if a.endswith(mark):
            return parameter_matches(a[: -len(mark)], b[: -len(mark)], lenient)
    if a.startswith("(") or b.startswith("("):
        x, y = (split_parameters(s[1:-1]) if s.startswith("(") else [] for s in (a, b))
        return len(x) == len(y) > 0 and all(parameter_matches(p, q, lenient) for p, q in zip(x, y))
    if "<" in a or "<" in b:
        (n1, _, r1), (n2, _, r2) = a.partition("<"), b.partition("<")
        x, y = split_parameters(r1.rstrip()[:-1]), split_parameters(r2.rstrip()[:-1])
        return len(x) == len(y) and parameter_matches(n1, n2, lenient) and all(parameter_matches(p, q, lenient) for p, q in zip(x, y))
    names = {b, ALIASES.get(b, b)} | {k for k, v in ALIASES.items() if v == b.rpartition(".")[2]}
    asked_for = {a, ALIASES.get(a, a)}
    return any(n == w or n.endswith("." + w) for n in names for w in asked_for)


def select_overloads(candidates: list[tuple[int, str]], parameters: list[str]) -> list[int]:
    """Ids of the (id, signature) whose parameters match, strictly if any does, else without regard to nullable marks."""
    for lenient in (False, True):
        found = []
        for id_, signature in candidates:
            declared = split_parameters(signature[signature.find("(") + 1 : signature.rfind(")")]) if "(" in signature else []
            if len(declared) == len(parameters) and all(parameter_matches(p, d, lenient) for p, d in zip(parameters, declared)):
                found.append(id_)
        if found:
            return found
    return []


def selectors(candidates: list[tuple[int, str, str]]) -> dict[int, str]:
    """For (id, short, signature) of one name, the shortest text that selects each: bare names of types, qualified one position after the other until they differ."""
    parts = {i: (s, split_parameters(g[g.find("(") + 1 : g.rfind(")")]) if "(" in g else None) for i, s, g in candidates}
    text = lambda i, full: parts[i][0] if parts[i][1] is None else f"{parts[i][0]}({', '.join(p if k in full else p.rpartition('.')[2] for k, p in enumerate(parts[i][1]))})"
    out = {}
    for i, (_, p) in parts.items():
        full: set[int] = set()
        for k in range(len(p or [])):
            if sum(text(j, full) == text(i, full) for j in parts) == 1:
                break
            full.add(k)
        out[i] = text(i, full)
    return out


def single(graph: Graph, text: str, project: str | None = None) -> int:
    """The id of the one node that a selector names; raises NotFound or Ambiguous."""
    from ..functions.predicates import project_matches

    name, parameters = parse_selector(text)
    found = resolve(graph, graph.nodes.sparkSession.createDataFrame([(name,)], "q string")).join(graph.nodes, "id")
    if project:
        found = found.where(project_matches("project", project))
    rows = found.orderBy("id").select("id", "signature", "short", "kind", "project", "file", "line").limit(41).collect()
    if parameters is not None:
        keep = set(select_overloads([(r["id"], r["signature"]) for r in rows], parameters))
        rows = [r for r in rows if r["id"] in keep]
    if not rows:
        raise NotFound(text)
    if len(rows) > 1:
        raise Ambiguous(text, rows[:12])
    return rows[0]["id"]


def suggest(graph: Graph, questions: DataFrame, take: int = 5, shortlist: int = 60, least: int = 30) -> DataFrame:
    """(q, id, score, why): the nodes nearest to a name that none has, by shared words, else by letters."""
    q = asked(questions.select("q").distinct().select("q", leaf("q").alias("q_leaf"), F.lower(owner("q")).alias("q_owner")).withColumn("q_tokens", identifier_tokens(F.col("q_leaf"))))
    nodes = graph.nodes.where("kind <> 'enum-member'").select("id", "short", leaf("short").alias("leaf")).withColumn("tokens", identifier_tokens(F.col("leaf")))
    shared = F.size(F.array_intersect("tokens", "q_tokens"))
    covered, recall = shared / F.size("tokens"), shared / F.size("q_tokens")
    same = (F.col("q_owner") != "") & F.contains(F.lower("short"), F.col("q_owner"))
    # Shared words are keys of a join; so are first letters with lengths for what may be a slip of the hand.
    words_of = F.broadcast(q.select("q", F.explode("q_tokens").alias("word")))
    pairs = nodes.select("id", F.explode("tokens").alias("word")).join(words_of, "word").select("q", "id").distinct().join(nodes, "id").join(q, "q")
    rough = pairs.withColumn("rough", (covered * 55 + recall * 25).cast("int") + F.when(same, 30).otherwise(0))
    rough = rough.withColumn("why", F.when(same, "same type").when(covered >= 1, "contains").otherwise("shares words"))
    by = lambda *o: F.row_number().over(Window.partitionBy("q").orderBy(*o))
    rough = rough.withColumn("place", by(F.desc("rough"), "id")).where(F.col("place") <= shortlist)
    distance = F.levenshtein(F.lower("leaf"), F.lower("q_leaf"))
    closeness = 1 - distance / F.greatest(F.length("leaf"), F.length("q_leaf"))
    words = rough.withColumn("score", F.col("rough") + (closeness * 20).cast("int")).where(F.col("score") >= least)
    size = F.length("q_leaf")
    slips = q.select("*", F.lower(F.substring("q_leaf", 1, 1)).alias("initial"), F.explode(F.sequence(size - 3, size + 3)).alias("size"))
    near = nodes.withColumns({"initial": F.lower(F.substring("leaf", 1, 1)), "size": F.length("leaf")}).join(F.broadcast(slips), ["initial", "size"])
    near = near.withColumn("d", F.levenshtein(F.lower("leaf"), F.lower("q_leaf"), 3)).where("d BETWEEN 1 AND 3").withColumn("score", 100 - 20 * F.col("d")).withColumn("why", F.lit("typo"))
    last = lambda df: df.withColumn("place", by(F.desc("score"), F.length("short"), "id")).where(F.col("place") <= take).select("q", "id", F.col("score").cast("long").alias("score"), "why")
    words = written(last(words))
    return words.unionByName(last(near.join(F.broadcast(words.select("q").distinct()), "q", "left_anti")))


def lexical(term: Column) -> Column:
    """(points, why) of a node for one term, by the first rule that holds."""
    t = F.lower(term)
    low = lambda c: F.lower(c)
    has = lambda c: F.contains(low(F.coalesce(F.col(c), F.lit(""))), t)
    routed = F.exists("tags", lambda x: (x.startswith("route:") | x.startswith("http:")) & F.contains(low(x), t))
    tiers = [
        (100, "name", low(leaf("short")) == t), (95, "name", low("short") == t), (78, "route", routed), (62, "name", F.contains(low(leaf("short")), t)), (52, "container", has("short")),
        (40, "namespace", has("name")), (28, "path", has("file")), (16, "signature", has("signature")),
    ]
    out = F.struct(F.lit(0).alias("points"), F.lit("").alias("why"))
    for points, why, rule in reversed(tiers):
        out = F.when(rule, F.struct(F.lit(points).alias("points"), F.lit(why).alias("why"))).otherwise(out)
    return out


def where_lexical(graph: Graph, terms: list[str]) -> DataFrame:
    """(id, short, lexical, why) of every node that a term finds: its best term's points, 25 more if all of several terms find it."""
    each = [lexical(F.lit(t)) for t in terms]
    all_met = F.when(reduce(lambda a, b: a & b, (e["points"] > 0 for e in each)), 25 if len(terms) > 1 else 0).otherwise(0)
    best = each[0]
    for e in each[1:]:
        best = F.when(e["points"] > best["points"], e).otherwise(best)
    rows = graph.nodes.where("kind <> 'enum-member'").select("*", best.alias("b"), all_met.alias("bonus")).where("b.points > 0")
    return rows.select("id", "short", "kind", "tags", "file", (F.col("b.points") + F.col("bonus")).alias("lexical"), "b.why")


def where(graph: Graph, terms: list[str], take: int = 8, candidates: int = 80, depth: int = 4) -> DataFrame:
    """(id, lexical, why, callers, entrypoints, score): the nodes to start from, ranked by words and by who reaches them.

    Reach is walked for the best `candidates` by words only, in full: how many nodes a walk visits isn't limited."""
    best = written(where_lexical(graph, terms).orderBy(F.desc("lexical"), F.length("short"), "id").limit(candidates))
    reached = walk.walk(walk.upstream(graph), walk.seeds(best, key=F.col("id")), depth, backward=True)
    eps = reached.join(graph.nodes.where(is_entrypoint()).select("id"), "id", "left_semi").groupBy(F.col("key").alias("id")).agg(F.count_distinct("id").alias("entrypoints"))
    callers = graph.edges.where("kind <> 'TypeUse'").join(best.select(F.col("id").alias("dst")), "dst", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("callers"))
    rows = best.join(eps, "id", "left").join(callers, "id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("entrypoints", "callers")})
    tag = lambda *starts: F.exists("tags", lambda t: reduce(lambda a, b: a | b, (t.startswith(s) for s in starts)))
    wired = tag("di:") | F.exists("tags", lambda t: t.isin("handler", "consumer", "hosted"))
    points = F.col("lexical") + F.least("entrypoints", F.lit(8)) * 9 + F.least("callers", F.lit(10)) * 3 + F.when(wired, 12).otherwise(0) + F.when(tag("route:", "http:"), 14).otherwise(0) + F.when(F.col("kind").isin("method", "property"), 6).otherwise(0)
    rows = rows.withColumn("score", points * F.when(is_test(), 0.35).otherwise(1.0) * F.when(F.col("file") == "", 0.5).otherwise(1.0))
    rows = demoted(written(rows))
    return rows.orderBy(F.desc("score"), F.desc("lexical"), F.length("short"), "id").limit(take).select("id", "lexical", "why", "callers", "entrypoints", F.round("score", 6).alias("score"))


def demoted(rows: DataFrame) -> DataFrame:
    """A node found through its container's name alone ranks below that container; repeated, for nested ones, until no score falls."""
    first = Window.partitionBy("short").orderBy(F.desc("lexical"), "id")
    while True:
        heads = rows.withColumn("n", F.row_number().over(first)).where("n = 1").select(F.col("short").alias("outer"), (F.col("score") - 0.001).alias("cap"))
        capped = rows.withColumn("outer", owner("short")).join(heads, "outer", "left").withColumn("new", F.when((F.col("why") == "container") & (F.col("score") > F.col("cap")), F.col("cap")).otherwise(F.col("score")))
        capped = written(capped)
        if capped.where("new < score").isEmpty():
            return rows
        rows = capped.drop("score", "outer", "cap").withColumnRenamed("new", "score")


def where_unranked(graph: Graph, terms: list[str]) -> DataFrame:
    """(key, id) of all nodes that a term finds."""
    return where_lexical(graph, terms).select("id").join(graph.nodes.select("id", "key"), "id").select("key", "id")


def missing(graph: Graph, questions: DataFrame) -> DataFrame:
    """(q, answer, text, id): for names that nothing answers to, what to say, by the first that applies.

    external: a type of that name is used but comes from elsewhere (its assembly). An input that is clearly no symbol: its kind.
    suggestion: a node with a similar name (its reason, its id), up to five. An input that may be no symbol: its kind. Else nothing."""
    ask = written(asked(questions.select("q").distinct()))
    spark = ask.sparkSession
    outside = graph.external_types if graph.external_types is not None else spark.createDataFrame([], "name string, assembly string")
    names = outside.agg(F.collect_set(F.when(F.col("assembly") != "", F.col("assembly"))).alias("assemblies"))  # a bounded list: see bind.record_external
    first = outside.groupBy(F.lower("name").alias("leaf")).agg(F.min("assembly").alias("assembly"))
    found = ask.crossJoin(F.broadcast(names)).select("q", F.lower(leaf("q")).alias("leaf"), question_kind(F.col("q"), F.col("assemblies")).alias("k")).join(first, "leaf", "left")
    near = suggest(graph, ask)
    found = written(found.join(near.select("q").distinct().withColumn("near", F.lit(True)), "q", "left"))
    what = F.when(F.col("assembly").isNotNull(), "external").when(F.col("k.decisive"), F.col("k.kind")).when(F.col("near"), "suggestion").when(F.col("k.kind") != "symbol", F.col("k.kind")).otherwise("nothing")
    rows = found.select("q", what.alias("answer"), F.when(F.col("assembly").isNotNull(), F.col("assembly")).otherwise("").alias("text"))
    hits = rows.where("answer = 'suggestion'").drop("text").join(near.select("q", F.col("why").alias("text"), "id"), "q")
    return rows.where("answer <> 'suggestion'").withColumn("id", F.lit(None).cast("long")).unionByName(hits)
