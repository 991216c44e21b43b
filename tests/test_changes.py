"""Changed lines against the standard library for every pair of texts, and what goes to Python and to the driver."""

import difflib

from pyspark.sql import functions as F

from foliary.operators import rules, templates

TEXTS = [None, "", "a", "b", "++b", "-a", "a\n", "a\nb", "a\rb", "c\x0bd", "a b", "x\x85y", "a\n++c", "a\x1cb\x1dc", "é"]


def by_hand(a, b):
    lines = difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), lineterm="")
    return sum(x.startswith(("+", "-")) and not x.startswith("+++") for x in lines)


def test_changes_are_those_of_the_library(spark):
    rows = spark.createDataFrame([(i, a, j, b) for i, a in enumerate(TEXTS) for j, b in enumerate(TEXTS)], "i int, a string, j int, b string")
    got = {(r["i"], r["j"]): r["n"] for r in rows.select("i", "j", templates.changes(F.col("a"), F.col("b")).alias("n")).collect()}
    assert got == {(i, j): by_hand(a, b) for i, a in enumerate(TEXTS) for j, b in enumerate(TEXTS)}
    side = lambda c: rows.select(F.col("i") * 100 + F.col("j"), F.lit(0), c).toDF("k", "pos", "text")
    found = {r["k"]: r["changes"] for r in templates.findings(side("a"), side("b"), "k").collect()}
    assert found == {100 * i + j: n for (i, j), n in got.items() if n}


def test_outermost_hits_broadcast_nothing_that_follows_the_input(spark):
    hits = spark.range(2000).select(F.lit("s").alias("source"), F.col("id").cast("string").alias("node_id"), F.lit("r").alias("rule"), F.when(F.col("id") % 2 == 1, F.array((F.col("id") - 1).cast("string"))).otherwise(F.array().cast("array<string>")).alias("ancestors"))
    found = rules.outermost(hits)
    assert found.count() == 1000
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
