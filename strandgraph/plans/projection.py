"""The property graph of the star schema: places, parties, orders and parts as nodes, keys and line items as edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import Graph
from ..tables import written

REGION, NATION, SUPPLIER, CUSTOMER, ORDER, PART = (k * 1_000_000_000 for k in range(1, 7))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("n_file", F.concat("r_name", F.lit("/"), "n_name"))


def _node(df: DataFrame, id_: Column, kind: str, name: Column, short: Column, project: str, file: Column | str = "", line: Column | int = 0, end: Column | int = 0, tags: Column | None = None) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(
        id_.cast("long").alias("id"), F.concat(F.lit(f"{kind}|"), name).alias("key"), name.alias("name"), short.alias("short"), F.lit(kind).alias("kind"), lit(file).alias("file"), lit(line).cast("int").alias("line"),
        lit(end).cast("int").alias("end_line"), F.concat(short, F.lit("()")).alias("signature"), F.col(project).alias("project"), (tags if tags is not None else F.array().cast("array<string>")).alias("tags"),
    )


def _dotted(*parts: str | Column) -> Column:
    return F.concat_ws(".", *parts)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = _places(spark, sf_dir)
    c = table(spark, sf_dir, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey"))
    test = F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("test"))
    tags = F.array_compact(F.array(F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("http:GET /customer/"), F.col("c_custkey").cast("string"))), test, F.when(F.col("c_mktsegment") == "AUTOMOBILE", F.lit("handler"))))
    first = 100 * F.col("c_custkey") + 1
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", nth.alias("nth")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    s = table(spark, sf_dir, "supplier").join(place, F.col("s_nationkey") == F.col("n_nationkey"))
    order, part = F.concat(F.lit("O"), F.col("o_orderkey").cast("string")), F.concat(F.lit("P"), F.col("p_partkey").cast("string"))
    parts = [
        _node(table(spark, sf_dir, "region"), REGION + F.col("r_regionkey"), "interface", F.col("r_name"), F.col("r_name"), "r_name"),
        _node(place, NATION + F.col("n_nationkey"), "type", _dotted("r_name", "n_name"), F.col("n_name"), "r_name", F.col("n_file"), 1, 2_000_000_000),
        _node(s, SUPPLIER + F.col("s_suppkey"), "type", _dotted("r_name", "n_name", "s_name"), _dotted("n_name", "s_name"), "r_name", tags=F.array(F.lit("repository"))),
        _node(c, CUSTOMER + F.col("c_custkey"), "method", _dotted("r_name", "n_name", "c_name"), _dotted("n_name", "c_name"), "r_name", F.col("n_file"), first, first + 98, tags),
        _node(o, ORDER + F.col("o_orderkey"), "method", _dotted("r_name", "n_name", "c_name", order), _dotted("c_name", order), "r_name", F.col("n_file"), first + F.col("nth"), first + F.col("nth"), F.array_compact(F.array(test))),
        _node(table(spark, sf_dir, "part"), PART + F.col("p_partkey"), "property", _dotted("p_brand", "p_name", part), _dotted("p_name", part), "p_brand"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _edge(df: DataFrame, src: Column, dst: Column, kind: str, note: Column | str | None = None, confidence: Column | None = None, source: Column | None = None, site: Column | None = None, role: Column | None = None) -> DataFrame:
    text = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("string")
    return df.select(
        src.cast("long").alias("src"), dst.cast("long").alias("dst"), F.lit(kind).alias("kind"), text(note).alias("note"), (confidence if confidence is not None else F.lit(None)).cast("double").alias("confidence"),
        text(source).alias("source"), text(site).alias("site"), (role if role is not None else F.lit(None)).cast("int").alias("role"),
    )


def accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line item as an access of a part by an order: R writes, A reads, N subscribes."""
    role = F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "A", 1).otherwise(4)
    site = F.concat(F.lit("lineitem:"), F.col("l_linenumber").cast("string"))
    return table(spark, sf_dir, "lineitem").select((ORDER + F.col("l_orderkey")).alias("src"), (PART + F.col("l_partkey")).alias("dst"), F.lit("Call").alias("kind"), role.alias("role"), site.alias("site"), F.col("l_linenumber").cast("long").alias("at"), "l_shipdate")


def edges(spark: SparkSession, sf_dir: str, shipped_before: str | None = None) -> DataFrame:
    place, customer, supplier, orders = (x for x in (_places(spark, sf_dir), *(table(spark, sf_dir, t) for t in ("customer", "supplier", "orders"))))
    items, used = table(spark, sf_dir, "lineitem"), accesses(spark, sf_dir)
    if shipped_before:
        items, used = (x.where(F.col("l_shipdate") < F.lit(shipped_before).cast("timestamp")) for x in (items, used))
    home = supplier.join(place, F.col("s_nationkey") == F.col("n_nationkey")).withColumn("rank", F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")))
    top = home.where("rank <= 2")
    nation, sup = NATION + F.col("s_nationkey"), SUPPLIER + F.col("s_suppkey")
    trade = (
        items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .where("c_nationkey <> s_nationkey").groupBy("c_nationkey", "s_nationkey").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
        .withColumn("rank", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("revenue"), "s_nationkey"))).where("rank <= 2")
    )
    sent = items.groupBy("l_orderkey", "l_suppkey").agg(F.min("l_returnflag").alias("flag"), F.max("l_discount").alias("discount"))
    weak = F.col("discount") >= 0.09
    parts = [
        _edge(place, REGION + F.col("r_regionkey"), NATION + F.col("n_nationkey"), "TypeUse", "member"),
        _edge(customer, NATION + F.col("c_nationkey"), CUSTOMER + F.col("c_custkey"), "TypeUse", "member"),
        _edge(supplier, nation, sup, "TypeUse", "member"),
        _edge(home, nation, sup, "Interface", F.when(F.col("rank") <= 2, "di-bound")),
        _edge(top, nation, sup, "DiBinding", F.when(F.col("s_acctbal") < 0, "transient").otherwise("scoped"), F.when(F.col("rank") == 2, 0.9), F.when(F.col("rank") == 2, "factory-lambda").otherwise("semantic-registration"), F.concat("n_file", F.lit(":"), F.col("s_suppkey").cast("string"))),
        _edge(trade, NATION + F.col("c_nationkey"), NATION + F.col("s_nationkey"), "Construct"),
        _edge(orders, CUSTOMER + F.col("o_custkey"), ORDER + F.col("o_orderkey"), "Call"),
        _edge(sent, ORDER + F.col("l_orderkey"), SUPPLIER + F.col("l_suppkey"), "Mediatr", F.concat(F.lit("via Send("), "flag", F.lit(")")), F.when(weak, 0.7), F.when(weak, "short-name-match").otherwise("semantic-request")),
        merge_accesses(used).select("src", "dst", "kind", F.lit("prop").alias("note"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("source"), "site", "role"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # Ids grow along a range-partitioned sort, so the order is total without a single task that numbers all rows.
    return out.sort("src", "dst", "kind").withColumn("ord", F.monotonically_increasing_id())


def merge_accesses(used: DataFrame) -> DataFrame:
    """Accesses (src, dst, kind, role, site, at) as one edge each: roles by bitwise or, and the first site that writes, else the first."""
    first = F.min(F.struct(F.when(F.col("role").bitwiseAND(2) != 0, 0).otherwise(1).alias("w"), "at", "site"))
    return used.groupBy("src", "dst", "kind").agg(F.bit_or("role").cast("int").alias("role"), first["site"].alias("site"))


def unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events as call sites that were not resolved."""
    place = _places(spark, sf_dir).select("n_nationkey", F.col("n_file").alias("file"), F.col("r_name").alias("project"))
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    kind = F.element_at(F.array(*map(F.lit, ("di", "mediatr", "type", "call"))), (F.col("event_id") % 4 + 1).cast("int"))
    reason = F.element_at(F.array(*map(F.lit, ("ambiguous-type-name", "no-handler", "type-outside-index"))), (F.col("user_id") % 3 + 1).cast("int"))
    return e.join(place, F.col("user_id") % 25 == F.col("n_nationkey")).select(kind.alias("kind"), "file", F.col("event_id").cast("int").alias("line"), F.col("props").alias("expression"), reason.alias("reason"), "project")


def usage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as invocations."""
    k = F.get_json_object("props", "$.k").cast("int")
    caller = F.when(F.col("user_id") % 5 == 0, "human").otherwise(F.concat(F.lit("agent-"), (F.col("user_id") % 3).cast("string")))
    code = F.when(k < 80, 0).when(k < 90, 2).when(k < 95, 4).otherwise(70)
    return table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("cmd"), caller.alias("caller"), (F.col("value") * 100).cast("long").alias("ms"), (k * 7).cast("int").alias("out_tokens"), code.cast("int").alias("exit"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session"))


def project_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): regions whose customers buy from suppliers of another of a later name; without cycles."""
    place = _places(spark, sf_dir).select("n_nationkey", "r_name")
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(place.withColumnsRenamed({"n_nationkey": "cn", "r_name": "src"}), F.col("c_nationkey") == F.col("cn"))
    s = table(spark, sf_dir, "supplier").join(place.withColumnsRenamed({"n_nationkey": "sn", "r_name": "dst"}), F.col("s_nationkey") == F.col("sn"))
    return table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).where("src < dst").select("src", "dst").distinct()


_indexes: dict[tuple, Graph] = {}


def _stamps(spark: SparkSession, sf_dir: str) -> tuple:
    """Size and time of the tables that the graph is made of."""
    out = []
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        out.append((fs.getContentSummary(path).getLength(), fs.getFileStatus(path).getModificationTime()))
    return tuple(out)


def index(spark: SparkSession, sf_dir: str, shipped_before: str | None = None) -> Graph:
    """The graph as tables, made once for an application and used again as long as the source tables have the same size and time.

    An earlier state, which is compared and not walked, shares the nodes and has plain edges."""
    key = (spark.sparkContext.applicationId, sf_dir, shipped_before, _stamps(spark, sf_dir))
    if key not in _indexes:
        if shipped_before:
            _indexes[key] = Graph(index(spark, sf_dir).nodes, written(edges(spark, sf_dir, shipped_before)))
        else:
            _indexes[key] = graph(spark, sf_dir).stored()
    return _indexes[key]


def graph(spark: SparkSession, sf_dir: str, shipped_before: str | None = None) -> Graph:
    return Graph(nodes(spark, sf_dir), edges(spark, sf_dir, shipped_before), unresolved=unresolved(spark, sf_dir))
