"""The graph document: one JSON object of a fixed format version, and where its snapshots are kept."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import Graph

#: The format this reader knows; any other is refused.
FORMAT = 15
#: The field names of the document.
NODE = "struct<id:long,key:string,name:string,short:string,kind:string,file:string,line:int,end_line:int,signature:string,project:string,tags:array<string>>"
EDGE = "struct<`from`:long,`to`:long,kind:string,note:string,confidence:double,source:string,site:string,role:string>"
SCALARS = {
    "format_version": "int", "root": "string", "built_at": "string", "built_from_commit": "string", "built_by_version": "string", "scope_decision": "string", "skipped_projects_reason": "string", "next_node_id": "int",
    "incremental_refreshes": "int", "unresolved_call_sites": "int", "total_call_sites": "int", "reference_count": "int", "indexed_all_projects": "boolean", "references_capped": "boolean",
}
SCHEMA = ", ".join([
    *(f"{k} {v}" for k, v in SCALARS.items()), f"nodes array<{NODE}>", f"edges array<{EDGE}>", "files array<struct<path:string,ticks:long,size:long,hash:string>>", "dirs array<struct<path:string,ticks:long>>",
    "unresolved array<struct<kind:string,file:string,line:int,expression:string,reason:string>>", "external_types array<struct<name:string,assembly:string,sites:array<string>>>",
    "diagnostics array<struct<id:string,count:int,message:string,project:string>>", "handlers_by_request map<string,array<int>>", "request_keys_by_short map<string,array<string>>", "project_references map<string,array<string>>",
    "unresolved_by_reason map<string,int>", "unresolved_by_project map<string,int>", "scan_registrations array<string>", "project_cycles array<string>", "skipped_projects array<string>",
])


class MissingGraph(FileNotFoundError):
    """No document stands at the path."""


class UnreadableGraph(ValueError):
    """What stands there is no graph document."""


class WrongFormat(ValueError):
    """The document is of another format version."""


def role_bits(text: Column) -> Column:
    """`Read, Write` as bits, null for null."""
    parts = F.split(text, r",\s*")
    bit = lambda name, b: F.when(F.array_contains(parts, name), b).otherwise(0)
    return F.when(text.isNotNull(), bit("Read", 1) + bit("Write", 2) + bit("Subscribe", 4))


def load(spark: SparkSession, path: str) -> Graph:
    """The graph of a document. Array positions stay as node order and edge order; of nodes with one key all are kept, edges without both ends are dropped."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs):
        raise MissingGraph(path)
    doc = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    heads = doc.select("format_version", F.col("nodes").isNotNull().alias("ok")).limit(2).collect()
    if len(heads) != 1 or heads[0]["format_version"] is None or not heads[0]["ok"]:
        raise UnreadableGraph(path)
    if heads[0]["format_version"] != FORMAT:
        raise WrongFormat(f"{path}: format {heads[0]['format_version']}, this reads {FORMAT}")
    rows = lambda name: doc.select(F.posexplode(name).alias("ord", "x")).select(F.col("ord").cast("long").alias("ord"), "x.*")
    text = lambda *names: {n: F.coalesce(n, F.lit("")) for n in names}
    nodes = rows("nodes").withColumns({**text("key", "name", "short", "kind", "file", "signature", "project"), "end_line": F.coalesce("end_line", "line"), "tags": F.coalesce("tags", F.array().cast("array<string>"))}).drop("ord")
    edges = rows("edges").withColumnsRenamed({"from": "src", "to": "dst"}).withColumn("role", role_bits(F.col("role")))
    for end in ("src", "dst"):
        edges = edges.join(nodes.select(F.col("id").alias(end)).distinct(), end, "left_semi")
    pairs = lambda name, a, b: doc.select(F.explode(name).alias(a, "v")).select(a, F.explode("v").alias(b))
    meta = doc.select(*(c for c in SCALARS), "unresolved_by_reason", "unresolved_by_project", F.to_timestamp("built_at").alias("built"))
    return Graph(
        nodes, edges.select("src", "dst", "kind", "note", "confidence", "source", "site", "role", "ord"), files=rows("files").drop("ord"), dirs=rows("dirs").drop("ord"), unresolved=rows("unresolved").drop("ord"),
        external_types=rows("external_types").drop("ord"), project_refs=pairs("project_references", "src", "dst"), handlers=pairs("handlers_by_request", "request", "handler"), diagnostics=rows("diagnostics").drop("ord"), meta=meta,
    )


class Contended(RuntimeError):
    """Another writer moved the pointer at the same time."""


#: The tables of a graph that a snapshot has, where the graph has them.
TABLES = ("nodes", "edges", "files", "dirs", "unresolved", "external_types", "project_refs", "handlers", "diagnostics", "meta")


class Snapshots:
    """Snapshots of a graph as Parquet below one folder of any file system.

    A pointer names the current snapshot and the one before. Pointers are numbered files that are made once and never changed, so a
    reader finds the newest whole one at any time, and of two writers one fails to make the next number. A snapshot is whole
    before a pointer names it; what a writer leaves that fails is never read."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, start: str) -> list[tuple[str, int]]:
        """Names below the root that begin with `start`, and when they were made."""
        root = self._path(self.root)
        found = self._fs.listStatus(root) if self._fs.exists(root) else []
        return sorted((s.getPath().getName(), s.getModificationTime()) for s in found if s.getPath().getName().startswith(start))

    def pointer(self) -> tuple[int, str | None, str | None]:
        """(number, current, previous) of the newest whole pointer; (0, None, None) without one."""
        for name, _ in reversed(self._names("pointer-")):
            text = "\n".join(r["value"] for r in self.spark.read.text(f"{self.root}/{name}").collect())  # three words
            words = text.split(" ")
            if len(words) == 3 and words[2] == "end":
                return int(name.removeprefix("pointer-")), words[0], None if words[1] == "-" else words[1]
        return 0, None, None

    def _point(self, current: str, rotate: bool, wait: bool) -> None:
        for attempt in range(20):
            _, was, before = self.pointer()
            last = max([0, *(int(n.removeprefix("pointer-")) for n, _ in self._names("pointer-"))])
            previous = (was if rotate else before) or "-"
            try:
                out = self._fs.create(self._path(f"{self.root}/pointer-{last + 1:012d}"), False)  # fails if it is there
            except Exception as e:
                if "exists" not in str(e).lower() or not wait:
                    raise Contended(self.root) from e
                time.sleep(0.05 * (attempt + 1))
                continue
            out.write(bytearray(f"{current} {previous} end".encode()))
            out.close()
            for name, _ in self._names("pointer-")[:-10]:
                self._fs.delete(self._path(f"{self.root}/{name}"), False)
            return
        raise Contended(self.root)

    def _write(self, graph: Graph, name: str) -> None:
        for t in TABLES:
            if (df := getattr(graph, t)) is not None:
                df.write.mode("overwrite").parquet(f"{self.root}/snapshot={name}/{t}")

    def save(self, graph: Graph, rotate: bool = True, wait: bool = True) -> str:
        """Writes a whole new snapshot, then moves the pointer; `rotate` makes the one before the previous, else that stays.

        If another writer is in the way, it is tried again, or, without `wait`, Contended is raised and nothing has changed."""
        name = uuid.uuid4().hex
        self._write(graph, name)
        self._point(name, rotate, wait)
        return name

    def load(self, name: str | None = None, previous: bool = False) -> Graph:
        """The tables of a snapshot: the current, the previous or a named one."""
        name = name or self.pointer()[2 if previous else 1]
        at = lambda t: f"{self.root}/snapshot={name}/{t}"
        if not name or not self._fs.exists(self._path(at("nodes"))):
            raise MissingGraph(self.root)
        return Graph(**{t: self.spark.read.parquet(at(t)) for t in TABLES if self._fs.exists(self._path(at(t)))})

    def base(self, commit: str, references: str) -> str:
        return f"base-{commit}-{references}"

    def save_base(self, graph: Graph, commit: str, references: str) -> str:
        """A snapshot of a commit under its name; the nodes, whose folder tells that it is whole, come last."""
        name = self.base(commit, references)
        self._fs.delete(self._path(f"{self.root}/snapshot={name}/nodes"), True)
        for t in reversed(TABLES):
            if (df := getattr(graph, t)) is not None:
                df.write.mode("overwrite").parquet(f"{self.root}/snapshot={name}/{t}")
        return name

    def prune(self, commit: str | None = None, references: str | None = None, keep: int = 5, older: float = 3600.0) -> list[str]:
        """Drops base snapshots of `commit` with other references, all but the `keep` newest, and ordinary ones that no pointer names, if they are `older` seconds old, as one that is being written has no pointer yet; the names of what went."""
        every = [(t, n.removeprefix("snapshot=")) for n, t in self._names("snapshot=")]
        found = [(t, n) for t, n in every if n.startswith("base-")]
        other = [n for _, n in found if commit and n.startswith(f"base-{commit}-") and n != self.base(commit, references or "")]
        rest = sorted(((t, n) for t, n in found if n not in other), reverse=True)
        named = self.pointer()[1:]
        loose = [n for t, n in every if not n.startswith("base-") and n not in named and time.time() - t / 1000 > older]
        gone = other + [n for _, n in rest[keep:]] + loose
        for n in gone:
            self._fs.delete(self._path(f"{self.root}/snapshot={n}"), True)
        return gone


#: Most references that make a key together.
MOST_REFERENCES = 100_000


def reference_key(references: DataFrame) -> str:
    """The first 12 hex digits of the SHA-256 of the sorted `name|size|ticks` lines of (name, size, ticks), at most MOST_REFERENCES."""
    if references.limit(MOST_REFERENCES + 1).count() > MOST_REFERENCES:
        raise ValueError(f"more than {MOST_REFERENCES} references")
    line = F.concat_ws("|", "name", F.col("size").cast("string"), F.col("ticks").cast("string"))
    return references.agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n").cast("binary"), 256), 1, 12).alias("k")).first()["k"]


def dirty_files(stamps: DataFrame, listing: DataFrame, moved_dirs: DataFrame | None = None, tolerance: int = 20_000_000) -> DataFrame:
    """(path, why): files that differ between stamps and a listing, both (path, ticks, size, hash).

    missing, size, time (beyond the tolerance in ticks of 100 ns), content (within it, but another hash), and new where a
    directory of `moved_dirs` (path), or any if not given, has them."""
    a, b = stamps.select("path", *(F.col(c).alias(f"a_{c}") for c in ("ticks", "size", "hash"))), listing.select("path", *(F.col(c).alias(f"b_{c}") for c in ("ticks", "size", "hash")))
    both = a.join(b, "path", "full_outer")
    off = F.abs(F.col("a_ticks") - F.col("b_ticks"))
    why = F.when(F.col("a_ticks").isNull(), "new").when(F.col("b_ticks").isNull(), "missing").when(F.col("a_size") != F.col("b_size"), "size").when(off > tolerance, "time").when((off > 0) & ~F.col("a_hash").eqNullSafe(F.col("b_hash")), "content")
    out = both.select("path", why.alias("why")).where("why IS NOT NULL")
    if moved_dirs is None:
        return out
    here = out.withColumn("dir", F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
    seen = here.join(moved_dirs.select(F.col("path").alias("dir")).distinct(), "dir", "left_semi").where("why = 'new'")
    return here.where("why <> 'new'").select("path", "why").unionByName(seen.select("path", "why"))


#: Folders and endings that hold no sources of one's own.
SKIPPED = ("bin", "obj", "node_modules", "packages", "TestResults", "artifacts")
GENERATED = (".g.cs", ".g.i.cs", ".designer.cs", ".generated.cs", ".assemblyinfo.cs")


def listing(spark: SparkSession, root: str, ending: str = ".cs", content: bool = False) -> DataFrame:
    """(path, ticks, size, hash): the source files below a folder of any file system; the hash only with `content`."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{ending}").load(root)
    top = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    path = F.substring(F.regexp_replace("path", r"^[a-z]+:(//[^/]*)?", ""), len(top) + 2, 1 << 20)
    low = F.lower(path)
    keep = ~path.rlike(r"(?i)(^|/)(\.[^/]+|" + "|".join(SKIPPED) + r")/")
    for g in GENERATED:
        keep = keep & ~low.endswith(g)
    hash_ = F.base64(F.unhex(F.sha2("content", 256))) if content else F.lit(None).cast("string")
    return df.where(keep).select(path.alias("path"), (F.unix_micros("modificationTime") * 10).alias("ticks"), F.col("length").alias("size"), hash_.alias("hash"))


def first_by_key(graph: Graph) -> DataFrame:
    """(key, id): of nodes that share a key, the first."""
    return graph.nodes.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where("n = 1").select("key", "id")
