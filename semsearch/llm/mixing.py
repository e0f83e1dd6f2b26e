"""Mixing sources to target weights by budgets that run down a tree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, small_or_not, stored

#: Words are counted as tokens.
WORD = r"[^\x20\x09-\x0D]+"


def weight_of(column: str, weights: dict[str, int] | None) -> Column:
    """The whole-number weight of a node from its value; 1 where none is given."""
    cases = F.lit(1)
    for value, weight in (weights or {}).items():
        cases = F.when(F.col(column) == value, F.lit(weight)).otherwise(cases)
    return cases.cast("long")


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], budget: int, max_epochs: int) -> DataFrame:
    """``leaves`` (the level columns and ``supply``) with the ``budget`` in tokens of each.

    A node can take what its leaves can give in ``max_epochs``.  From the root down,
    a node's budget is dealt to its children by weight; what a child cannot take
    goes to its siblings by their weights.  As no node is given more than all below
    it can take, shortages reach an ancestor's other children only when the siblings
    are full.  Shares are whole tokens; a node of weight 0 takes none.
    """
    able = reduce(lambda a, b: a * b, [F.least(weight_of(x, weights.get(x)), F.lit(1)) for x in levels])
    tree = leaves.withColumn("_cap", F.col("supply") * max_epochs * able).withColumn("_budget", F.lit(None).cast("long"))
    for depth in range(len(levels)):
        path, parent = levels[: depth + 1], levels[:depth]
        nodes = tree.groupBy(*path).agg(F.sum("_cap").alias("cap"), F.max("_budget").alias("given")).withColumn("w", weight_of(levels[depth], weights.get(levels[depth])))
        siblings = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
        given = F.least(F.col("given") if parent else F.lit(budget), F.sum("cap").over(siblings))
        # the children that fill up first, by capacity for their weight, come first
        order = siblings.orderBy(F.try_divide("cap", "w").asc_nulls_last(), F.col(levels[depth]))
        so_far = order.rowsBetween(Window.unboundedPreceding, -1)
        dealt = nodes.select(
            *path, "cap", "w", given.alias("given"),
            F.coalesce(F.sum("cap").over(so_far), F.lit(0)).alias("before"),
            (F.sum("w").over(siblings) - F.coalesce(F.sum("w").over(so_far), F.lit(0))).alias("rest"),
        )
        full = F.col("cap") * F.col("rest") <= F.col("w") * (F.col("given") - F.col("before"))
        dealt = dealt.withColumn("full", full)
        taken = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(siblings)
        open_weight = F.sum(F.when(F.col("full"), F.lit(0)).otherwise(F.col("w"))).over(siblings)
        share = F.when(F.col("full"), F.col("cap")).otherwise(F.expr("w * (given - taken) div open_weight"))
        shares = dealt.withColumn("taken", taken).withColumn("open_weight", open_weight).select(*path, share.alias("_share"))
        tree = tree.join(shares, path).withColumn("_budget", F.col("_share")).drop("_share")
    return tree.select(*levels, "supply", F.col("_budget").alias("budget"))


def mix(
    df: DataFrame, levels: dict[str, Column], weights: dict[str, dict[str, int]], budget_percent: int,
    max_epochs: int = 1, seed: int = 1, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """The documents of a mixture: _row, doc_id, the levels, n_tokens, copies, epoch.

    ``levels`` names the tree's levels from the root with an expression for each;
    the budget is ``budget_percent`` of all tokens (words).  A leaf passes over its
    documents in whole epochs and takes from the last one the longest prefix that
    fits, in an order seeded by seed, epoch and document.

    Counts per leaf are formed where the rows are.  An epoch's order is cut into
    256 chunks by hash, so running sums of a leaf that holds a third of all
    documents are formed by many tasks, from chunk sums.
    A null level value is the value ``''``; a null text has no tokens and goes with
    whatever precedes it; identical rows (``copies``) go together; an empty table
    gives no rows.  Other columns are not read.
    """
    names = list(levels)
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    rows = df.select(
        df[id_col].cast("long").alias("doc_id"), *(F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in levels.items()),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_tokens"), F.xxhash64(text).alias("_t"),
    )
    keyed = rows.withColumn("_row", F.xxhash64("doc_id", "_t", *names)).groupBy("_row", "doc_id", *names).agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("copies"))
    docs = stored(keyed, "mix-documents")
    leaves = stored(docs.groupBy(*names).agg(F.sum("n_tokens").alias("supply")), "leaves")
    total = leaves.agg(F.sum("supply")).first()[0] or 0
    plan = stored(leaf_budgets(leaves, names, weights, total * budget_percent // 100, max_epochs), "leaf-budgets")
    plan = plan.where("supply > 0 and budget > 0").select(*names, F.expr("budget div supply").alias("_whole"), (F.col("budget") % F.col("supply")).alias("_rest"))
    planned = docs.join(small_or_not(plan), names)
    whole = planned.where("_whole > 0").withColumn("epoch", F.explode(F.expr("sequence(0L, _whole - 1)")))
    key = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("_whole"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    last = planned.where("_rest > 0").withColumn("_key", key).withColumn("_chunk", F.substring("_key", 1, 2))
    sums = last.groupBy(*names, "_chunk").agg(F.sum("n_tokens").alias("_sum"))
    before = Window.partitionBy(*names).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*names, "_chunk", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    running = Window.partitionBy(*names, "_chunk").orderBy("_key", "doc_id", "_row").rowsBetween(Window.unboundedPreceding, 0)
    summed = last.withColumn("_running", F.sum("n_tokens").over(running)).join(sums, [*names, "_chunk"])
    prefix = summed.where(F.col("_before") + F.col("_running") <= F.col("_rest")).withColumn("epoch", F.col("_whole"))
    columns = ["_row", "doc_id", *names, "n_tokens", "copies", F.col("epoch").cast("int").alias("epoch")]
    return whole.select(*columns).unionByName(prefix.select(*columns))


def mixed_documents(df: DataFrame, levels: dict[str, Column], weights: dict[str, dict[str, int]], budget_percent: int, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that a mixture of one epoch takes, with all their columns.

    Nulls, repeated rows and empty tables are as in ``mix``; columns of clashing names stay.
    """
    name = free_name(df, "_row")
    chosen = stored(mix(df, levels, weights, budget_percent, 1, seed, id_col, text_col).select(F.col("_row").alias(name)).distinct(), "mixture")
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    row = F.xxhash64(df[id_col].cast("long"), F.xxhash64(text), *(F.coalesce(c.cast("string"), F.lit("")) for c in levels.values()))
    return df.join(small_or_not(chosen), row == chosen[name], "left_semi")
