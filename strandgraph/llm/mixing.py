"""Mixing sources to target weights by hierarchical budgeting, with DataFrame functions only.

The levels (domain, language, source) form a tree whose leaves hold documents. A budget of tokens is handed
down the tree: siblings share by weight, a child that can't use its share takes all it can (its subtree's
tokens times `max_epochs`), and what it leaves goes to its siblings before it goes back to an ancestor's. As the
budget of a node never exceeds what its subtree can take, one pass from the root settles all shortages.

A leaf takes whole epochs, then the longest prefix of its documents, in an order seeded anew for each epoch, whose
tokens fit. The end of the prefix is found by sums over 256 ranges of the order, 256 ranges of one of these and again
256, so that no task holds a hot leaf; all arithmetic is on integers. The sum of all weights may be up to 10**5."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _weight(path: list[str], weights: Mapping[tuple[str, ...], int]) -> Column:
    """The weight of the node at `path`, 1 unless given."""
    out = F.lit(1)
    for key, w in weights.items():
        if len(key) == len(path):
            out = F.when(reduce(lambda a, b: a & b, (F.col(c) == k for c, k in zip(path, key))), F.lit(w)).otherwise(out)
    return out.cast("long")


def waterfill(nodes: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Adds `given` to rows with capacity `cap`, weight `w` and the parent's `budget`: a share by weight, at most cap."""
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    before = by.orderBy(F.col("cap") / F.col("w"), child).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    out = nodes.where("w > 0").withColumns({"_c": zero(F.sum("cap").over(before)), "_v": zero(F.sum("w").over(before)), "_w": F.sum("w").over(by)})
    out = out.withColumn("_full", F.expr("_c * w + cap * (_w - _v) <= budget * w"))
    out = out.withColumns({"_s": zero(F.sum(F.expr("IF(_full, cap, 0L)")).over(by)), "_r": zero(F.sum(F.expr("IF(_full, 0L, w)")).over(by))})
    return out.withColumn("given", F.expr("IF(_full, cap, (budget - _s) * w div _r)")).drop("_c", "_v", "_w", "_full", "_s", "_r")


def leaf_budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[tuple[str, ...], int], budget: Column, max_epochs: int) -> DataFrame:
    """(levels, tokens, given) for each leaf of (levels, tokens) rows."""
    levels = list(levels)
    up: DataFrame | None = None
    for d in range(1, len(levels) + 1):
        path = levels[:d]
        nodes = leaves.groupBy(*path).agg((F.sum("tokens") * max_epochs).alias("cap"), F.sum("tokens").alias("tokens")).withColumn("w", _weight(path, weights))
        nodes = nodes.join(up, path[:-1]) if up is not None else nodes.crossJoin(leaves.agg(budget.alias("budget")))  # one row: the root's budget
        filled = waterfill(nodes, path[:-1], path[-1])
        up = filled.select(*path, F.col("given").alias("budget"))
    return filled.select(*levels, "tokens", "given")


def identity(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Column:
    """What a row is known by: its doc_id and, if it has a text, a digest of that, so that many rows without an id don't stand together."""
    own = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.concat(own, F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))) if text in docs.columns else own


def order_key(seed: int, epoch: Column, own: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), own).cast("binary"))


def mix(
    docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[tuple[str, ...], int], budget: Column | int, max_epochs: int = 3, seed: int = 7, tokens: Column | None = None, doc_id: str = "doc_id"
) -> DataFrame:
    """The rows of `docs`, once for each epoch that takes them, with `n_tokens`, `epoch` (from 0), `leaf_budget` and the levels as `level_<name>`.

    `budget` is a number of tokens or an expression over the leaves' `tokens`. Nulls in a level count as an
    empty name, a null text has no tokens. Rows of a leaf that are equal in doc_id and text stay together at the
    end of a prefix. A leaf without tokens, or below a node of weight 0, gives nothing. An empty table gives an
    empty result. Columns of `docs` that the added ones name are replaced."""
    names = [f"level_{x}" for x in levels]
    added = {**{n: F.coalesce(c.cast("string"), F.lit("")) for n, c in zip(names, levels.values())}, "n_tokens": tokens if tokens is not None else word_count(F.col("text"))}
    base = docs.drop("epoch", "leaf_budget").withColumns(added)
    narrow = written(base.select(*names, identity(docs, doc_id).alias("id"), "n_tokens"))
    leaves = written(narrow.groupBy(*names).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0"))
    budget = budget if isinstance(budget, Column) else F.lit(budget).cast("long")
    plan = leaf_budgets(leaves, names, weights, budget, max_epochs)
    plan = written(plan.select(*names, F.expr("given div tokens AS whole"), F.expr("given % tokens AS rest"), F.col("given").alias("leaf_budget")))
    # Narrow down where the prefix of each leaf ends: the range of the first 2 digits, of 4, of 6, and the row.
    at = narrow.join(plan.where("rest > 0"), names).withColumn("key", order_key(seed, F.col("whole"), F.col("id"))).select(*names, "key", "n_tokens", "rest")
    found, have = None, F.lit(0).cast("long")
    for digits in (2, 4, 6):
        part = F.substring("key", 1, digits).alias("part")
        rows = at if found is None else at.join(found.select(*names, F.col("part").alias("_p"), F.col("have").alias("_h")), names).where(F.col("key").startswith(F.col("_p")))
        have = F.lit(0).cast("long") if found is None else F.col("_h")
        sums = rows.groupBy(*names, part, "rest", have.alias("base")).agg(F.sum("n_tokens").alias("n"))
        upto = F.sum("n").over(Window.partitionBy(*names).orderBy("part")) + F.col("base")
        sums = sums.withColumn("upto", upto)
        found = written(sums.where("upto > rest AND upto - n <= rest").select(*names, "part", (F.col("upto") - F.col("n")).alias("have")))
    last = at.join(found, names).where(F.col("key").startswith(F.col("part")))
    running = F.sum("n_tokens").over(Window.partitionBy(*names).orderBy("key").rangeBetween(Window.unboundedPreceding, 0)) + F.col("have")
    fits = last.withColumn("upto", running).groupBy(*names, "part").agg(F.max(F.expr("IF(upto <= rest, key, NULL)")).alias("last"))
    ends = fits.select(*names, F.coalesce("last", "part").alias("end"))
    plan = written(plan.join(ends, names, "left"))
    key = order_key(seed, F.col("whole"), identity(docs, doc_id))
    count = F.col("whole") + F.when(F.col("end").isNotNull() & (key <= F.col("end")), 1).otherwise(0)
    return base.join(plan, names).where(count > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), count - 1))).drop("whole", "rest", "end")
