"""How rows of an answer read: relation, marks, places, tags, and what to do about a failure. All are Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .predicates import score

#: The word for each kind of edge (`call` for any other), and the tags that an answer shows.
RELATIONS = {"Mediatr": "mediatr", "Interface": "impl", "Override": "override", "Route": "route", "Construct": "new", "DiBinding": "di"}
SHOWN_TAGS = ("handler", "dbcontext", "consumer", "validator", "obsolete")
SHOWN_PREFIXES = ("http:", "route:", "endpoint:")

#: What each reason of a failure asks for.
REMEDIES = {
    "no-candidate-symbol": "build the solution, so that its assemblies are there, and index again",
    "unbound-type": "build the solution, so that its assemblies are there, and index again",
    "ambiguous-overload": "the edge leads to the first candidate; see which overload is meant",
    "ambiguous-type-name": "several types have this name, so none was bound",
    "ambiguous-request-name": "several requests have this name, so none was dispatched",
    "no-handler": "nothing here handles this request; look for it in another solution",
    "assembly-scan-unfiltered": "a scan without a filter binds all types; no pairs are guessed",
}


def relation(kind: Column | str = "kind") -> Column:
    k, out = F.col(kind) if isinstance(kind, str) else kind, F.lit("call")
    for name, word in RELATIONS.items():
        out = F.when(k == name, word).otherwise(out)
    return out


def mark(kind: str = "kind", note: str = "note", confidence: str = "confidence", source: str = "source") -> Column:
    """`[impl, di-bound ?0.90 factory]`: what kind of edge it is and, below certainty, its score and source; empty for a certain call."""
    k, t, s = F.col(kind), F.col(note), score(confidence)
    word = (
        F.when(k.isin("Mediatr", "Route"), F.concat_ws(" ", relation(k), t)).when(k.isin("Interface", "Override"), F.concat(relation(k), F.when(t.eqNullSafe("di-bound"), ", di-bound").otherwise("")))
        .when(k == "Construct", "new").when(k == "DiBinding", F.concat(F.lit("di:"), F.coalesce(t, F.lit("")))).otherwise("")
    )
    doubt = F.when(s < 1, F.concat_ws(" ", F.concat(F.lit("?"), F.format_string("%.2f", s)), F.col(source))).otherwise("")
    inner = F.concat_ws(" ", F.when(word != "", word), F.when(doubt != "", doubt))
    return F.when(inner == "", "").otherwise(F.concat(F.lit("["), inner, F.lit("]")))


def line_span(line: str = "line", end_line: str = "end_line") -> Column:
    return F.when(F.col(end_line) > F.col(line), F.concat_ws("-", F.col(line).cast("string"), F.col(end_line).cast("string"))).otherwise(F.col(line).cast("string"))


def place(file: str = "file") -> Column:
    """`file:first-last`, empty without a file."""
    return F.when(F.col(file) != "", F.concat(F.col(file), F.lit(":"), line_span())).otherwise("")


def shown_tags(tags: str = "tags") -> Column:
    def shown(t: Column) -> Column:
        out = t.isin(*SHOWN_TAGS)
        for p in SHOWN_PREFIXES:
            out = out | t.startswith(p)
        return out

    return F.filter(tags, shown)


def answer(nodes: DataFrame, dirty: DataFrame | None = None) -> DataFrame:
    """Nodes, with the columns of their edge if they have them, as the rows of an answer; stale where the file is among `dirty` (file)."""
    have = lambda c, kind: F.col(c) if c in nodes.columns else F.lit(None).cast(kind)
    rows = nodes
    if dirty is None:
        rows = rows.withColumn("stale", F.lit(False))
    else:
        changed = dirty.select(F.lower("file").alias("_f")).distinct().withColumn("stale", F.lit(True))
        rows = rows.join(changed, F.lower("file") == F.col("_f"), "left").withColumn("stale", F.coalesce("stale", F.lit(False)) & (F.col("file") != "")).drop("_f")
    return rows.select(
        have("level", "int").alias("depth"), F.col("short").alias("symbol"), "kind", have("relation", "string").alias("relation"), have("note", "string").alias("note"), F.when(F.col("file") != "", F.col("file")).alias("file"), "line",
        F.greatest("end_line", "line").alias("end_line"), "stale", have("confidence", "double").alias("confidence"), have("source", "string").alias("source"), have("site", "string").alias("site"), "id",
        F.when(F.col("project") != "", F.col("project")).alias("project"), F.when(F.size("tags") > 0, F.col("tags")).alias("tags"),
    )


def remedy(reason: Column | str = "reason") -> Column:
    r, out = F.col(reason) if isinstance(reason, str) else reason, F.lit("open the file to see")
    for name, text in REMEDIES.items():
        out = F.when(r == name, text).otherwise(out)
    return out
