import duckdb
from pyspark.sql import functions as F

from strandgraph.llm import mixing, queries

SF = "/root/testdata/sf0.001"


def fill(spark, rows, budget):
    df = spark.createDataFrame([(*r, budget) for r in rows], "name string, cap long, w long, budget long")
    return {r["name"]: r["given"] for r in mixing.waterfill(df, [], "name").collect()}


def test_waterfill(spark):
    assert fill(spark, [("a", 10, 1), ("b", 100, 1), ("c", 100, 2)], 90) == {"a": 10, "b": 26, "c": 53}
    assert fill(spark, [("a", 10, 1), ("b", 5, 1)], 90) == {"a": 10, "b": 5}
    assert fill(spark, [("a", 10, 1), ("b", 10, 0)], 4) == {"a": 4}


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("x", "x1", 10), ("x", "x2", 1000), ("y", "y1", 1000)], "d string, s string, tokens long")
    got = {r["s"]: r["given"] for r in mixing.leaf_budgets(leaves, ["d", "s"], {}, F.lit(200).cast("long"), 1).collect()}
    assert got == {"x1": 10, "x2": 90, "y1": 100}
    small = spark.createDataFrame([("x", "x1", 10), ("x", "x2", 20), ("y", "y1", 1000)], "d string, s string, tokens long")
    got = {r["s"]: r["given"] for r in mixing.leaf_budgets(small, ["d", "s"], {}, F.lit(200).cast("long"), 1).collect()}
    assert got == {"x1": 10, "x2": 20, "y1": 170}


def test_query_is_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = queries.op2_mixing(spark, SF)
    want = con.sql(queries.SQL["op2_mixing"])
    order = [want.columns.index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[k] for k in order) for r in want.fetchall())


def test_prefixes_against_brute_force(spark):
    import hashlib
    import random

    r = random.Random(5)
    rows = [(k, " ".join("w" * r.randint(0, 40)), r.choice("ab"), None if k % 7 else "s") for k in range(400)] + [(None, f"q {'w ' * k}", "a", None) for k in range(9)] + [(3, "again and again", "a", None), (3, "again and again", "a", None), (9000, None, "b", "s"), (9001, "", "zero", "zero")]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, lang string, source string, epoch string")
    out = mixing.mix(df, {"lang": F.col("lang"), "source": F.col("source")}, {("a",): 2}, 2500, max_epochs=2, seed=1)
    got = sorted((str(x["doc_id"]), x["level_lang"], x["level_source"], x["epoch"]) for x in out.collect())
    plan = {(x["level_lang"], x["level_source"]): x["leaf_budget"] for x in out.select("level_lang", "level_source", "leaf_budget").distinct().collect()}
    want = []
    for (lang, source), given in plan.items():
        own = [(i, t or "", len((t or "").split())) for i, t, a, s in rows if (a, s or "") == (lang, source)]
        whole, rest = divmod(given, sum(n for *_, n in own))
        key = lambda i, t: hashlib.md5(f"1:{whole}:{'' if i is None else i}:{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest()  # noqa: B023, E731
        for i, t, _ in own:
            upto = sum(n for j, u, n in own if key(j, u) <= key(i, t))
            want += [(str(i), lang, source, e) for e in range(whole + (rest > 0 and upto <= rest))]
    assert got == sorted(want) and 2400 < sum(plan.values()) <= 2500


def test_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert queries.mixed(df).count() == 0
