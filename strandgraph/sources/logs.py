"""Line files: the usage log, the baseline of accepted findings, diff text, and the sinks of answers."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .document import FORMAT, WrongFormat

#: The fields of an invocation.
USAGE = (
    "schema_version int, ts string, cmd string, args string, budget int, exit int, ms long, out_tokens int, would_be_tokens int, reserved_tokens int, files_referenced int, nodes int, edges int, caller string, "
    "caller_via string, tty boolean, session string, parents string"
)
_NAMES = [x.split()[0] for x in USAGE.split(", ")]


def _typed(lines: DataFrame) -> DataFrame:
    """Rows of JSON lines; field names are matched without regard to case and underscores, so that older lines read too. Lines that are no object are dropped."""
    fields = F.from_json(F.col("value"), "map<string,string>")
    plain = F.transform_keys(fields, lambda k, _: F.replace(F.lower(k), F.lit("_"), F.lit("")))
    kinds = {x.split()[0]: x.split()[1] for x in USAGE.split(", ")}
    got = lines.select(plain.alias("m")).where("m IS NOT NULL AND map_contains_key(m, 'cmd')")
    out = got.select(*(F.col("m")[n.replace("_", "")].try_cast(kinds[n]).alias(n) for n in _NAMES))
    return out.withColumn("ts", F.try_to_timestamp("ts"))


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    return _typed(spark.read.text(path))


def stream_usage(spark: SparkSession, path: str) -> DataFrame:
    """The same of a folder that grows."""
    return _typed(spark.readStream.text(path))


def append_usage(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct(*(c for c in _NAMES if c in rows.columns)), {"timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}).alias("value")).write.mode("append").text(path)


_FORMAT = "# format"


def baseline_format(spark: SparkSession, path: str) -> int:
    """The format of the graph that a baseline's ids come from; 0 if it doesn't say, which no graph has."""
    said = spark.read.text(path).select(F.regexp_extract(F.trim("value"), rf"^{_FORMAT}\s+(\d+)\s*$", 1).alias("n")).where("n <> ''")
    return said.agg(F.coalesce(F.max(F.col("n").cast("int")), F.lit(0)).alias("n")).first()["n"]


def accepted(spark: SparkSession, path: str, expected: int = FORMAT) -> DataFrame:
    """(id) of the accepted findings; WrongFormat if the ids are of another format, as none would match a finding then. Without a file there are none."""
    if not (at := spark._jvm.org.apache.hadoop.fs.Path(path)).getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "id string")
    if (found := baseline_format(spark, path)) != expected:
        raise WrongFormat(f"{path}: ids of format {found}, the graph's is {expected}; accept the findings anew")
    return read_baseline(spark, path).select("id")


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) of accepted findings: `id text` lines; # begins a comment."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> '' AND NOT startswith(v, '#')")
    return lines.select(F.split("v", " ", 2)[0].alias("id"), F.trim(F.coalesce(F.get(F.split("v", " ", 2), F.lit(1)), F.lit(""))).alias("text")).dropDuplicates(["id"])


def write_baseline(found: DataFrame, path: str, before: DataFrame | None = None) -> int:
    """Writes (id, text) rows as the baseline and tells how many ids of the one before are gone from it."""
    pruned = 0 if before is None else before.join(found.select("id"), "id", "left_anti").count()
    head = found.sparkSession.createDataFrame([(0, f"{_FORMAT} {FORMAT}")], "o int, value string")
    body = found.select(F.lit(1).alias("o"), F.concat_ws(" ", "id", F.regexp_replace("text", r"[\r\n]+", " ")).alias("value"))
    # One small file that people read and keep under version control.
    head.unionByName(body).repartition(1).sortWithinPartitions("o", "value").select("value").write.mode("overwrite").text(path)
    return pruned


def read_diff(spark: SparkSession, text: str | Iterable[str]) -> DataFrame:
    """(ord, text) of a diff's lines, as compare.hunk_lines takes them."""
    lines = text.splitlines() if isinstance(text, str) else list(text)
    return spark.createDataFrame(list(enumerate(lines)), "ord int, text string")


def envelope(rows: DataFrame, status: int, most: int = 1000) -> str:
    """The answer as one JSON object: status, rows (at most `most`, the bound of an answer) and whether more were left."""
    import json

    got = [r["x"] for r in rows.limit(most + 1).select(F.to_json(F.struct("*")).alias("x")).collect()]
    return json.dumps({"exit": status, "rows": [json.loads(x) for x in got[:most]], "truncated": len(got) > most})


class OutsideRoot(ValueError):
    """A file is to be written outside of the folder that holds all of them, or where no folder is."""


def confined(spark: SparkSession, root: str, path: str) -> str:
    """Where `path`, taken from `root`, stands; raises OutsideRoot unless that is below root, in a folder that exists."""
    of = spark._jvm.org.apache.hadoop.fs.Path
    top = of(root).getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(of(root))
    whole = of(top, of(path))  # an absolute path stays what it is
    whole = whole.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(whole)
    here, there = whole.toUri(), top.toUri()
    if ".." in here.getPath().split("/") or here.getScheme() != there.getScheme() or (here.getAuthority() or "") != (there.getAuthority() or "") or not here.getPath().startswith(there.getPath().rstrip("/") + "/"):
        raise OutsideRoot(f"{path} is outside of {root}")
    if not whole.getFileSystem(spark._jsc.hadoopConfiguration()).exists(whole.getParent()):
        raise OutsideRoot(f"{path} has no folder to stand in")
    return whole.toString()


def write_diagram(lines: DataFrame, root: str, path: str, drawn: DataFrame, left_out: DataFrame) -> list[str]:
    """Writes (place, line) rows below `root`, beside the file first and then in its place, and returns what there is to say of it.

    drawn: (a, b, ...) as `structure.exported` gives it; left_out: one row as `structure.withheld` gives it."""
    spark = lines.sparkSession
    end = confined(spark, root, path)
    part = f"{end}.{uuid.uuid4().hex}"
    write_lines(lines, part)
    of = spark._jvm.org.apache.hadoop.fs.Path
    fs = of(end).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(of(end), True)  # the whole new one stands beside it
    if not fs.rename(of(part), of(end)):
        raise OSError(f"{path} can't be put in place; it is in {part}")
    names = drawn.select(F.explode(F.array("a", "b")).alias("n")).distinct().count()
    said = [f"{path}: nodes: {names}, edges: {drawn.count()}"]
    why = {"tests": "test code", "type_use": "type use", "within": "within a group", "synthetic": "synthetic"}
    row = left_out.first().asDict()
    held = [f"{text} {row[k]} edge(s)" for k, text in why.items() if row.get(k)]
    return said + (["withheld: " + "; ".join(held)] if held else [])


def write_lines(df: DataFrame, path: str) -> None:
    """(place, line) rows as one text file, in order. What is drawn was collapsed before; it is a page, not a table."""
    df.repartition(1).sortWithinPartitions("place").select(F.col("line").alias("value")).write.mode("overwrite").text(path)
