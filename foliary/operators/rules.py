"""Rule packs over section titles and score tables over lines. A pack is a DataFrame, so another domain is other rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliary.functions import text as T
from foliary.operators.templates import holding

# Scores in a line.
SCORE, FULL_SCORE = r"(\d+(?:\.\d+)?)\s*分", r"(?:满分|共|总计|合计)\s*(\d+(?:\.\d+)?)\s*分"


def keyword_hits(sections: DataFrame, pack: DataFrame) -> DataFrame:
    """Sections (source, node_id, title ..) whose title contains a rule's keyword (kind 'contains') or is it ('exact'), both
    without white space and punctuation; where a source has exact hits of a rule, only those count."""
    words = pack.select("rule", "kind", T.title_key(F.col("keyword")).alias("word"))
    rows = sections.withColumn("word", T.title_key(F.col("title")))
    exact = rows.join(words.where("kind = 'exact'"), "word").select(*sections.columns, "rule", "kind")
    parts = words.where("kind = 'contains'")
    # Titles repeat, so each distinct one is searched once.
    titles = rows.select("word").distinct()
    held = holding(titles, "word", F.col("word"), parts, F.col("word")).select("word", "term").join(parts.withColumnRenamed("word", "term"), "term").select("word", "rule", "kind")
    hits = exact.unionByName(rows.join(held, "word").select(*sections.columns, "rule", "kind")).distinct()
    exact = F.max(F.col("kind") == "exact").over(Window.partitionBy("source", "rule"))
    return hits.withColumn("any_exact", exact).where("not any_exact or kind = 'exact'").drop("any_exact")


def outermost(hits: DataFrame) -> DataFrame:
    """Hits none of whose ancestors is a hit of the same rule and source."""
    up = hits.select("source", "rule", F.col("node_id"), F.explode("ancestors").alias("up"))
    held = hits.select("source", "rule", F.col("node_id").alias("up")).distinct()
    # Both follow the input, so neither goes to all executors through the driver while it is still small enough for that.
    below = up.join(held.hint("merge"), ["source", "rule", "up"]).select("source", "rule", "node_id").distinct()
    return hits.join(below.hint("merge"), ["source", "rule", "node_id"], "left_anti")


def constraint_rows(lines: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key.., kind, value, text): constraints of every line, each kind and value once a line."""
    return lines.withColumn("c", F.explode(T.constraints(F.col(text)))).select(*key, "c.kind", "c.value", F.substring(text, 1, 200).alias("text"))


def carried(lines: DataFrame, key: str, order: str, category: str) -> DataFrame:
    """Lines with the last category at or before them; those before the first one go."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("category", F.last(category, True).over(w)).where("category is not null")


# Parts of a score table's lines.
CATEGORY_WORDS = r"商务|技术|价格|资信|报价"
PER_ITEM = r"每(?:项|个|条).*?\d+(?:\.\d+)?\s*分"
ITEM_PREFIX = r"^[\s]*(?:\(?\d+\)|[一二三四五六七八九十]+[、.．]|\d+[、.．])"
CATEGORY_TOTAL = r"(?:满分|合计|总计|总分|共)\s*\d+(?:\.\d+)?\s*分"
CATEGORY_NOTE = r"[（(][^）)]*(?:满分|合计|总计|总分)[^）)]*[）)]\s*$"
MATERIAL_LEAD, MATERIAL_BRACKET = r"(?:提供|附|须附|需附)[：:]?([^。\n]{2,60})", r"（([^（）]{2,40})）"
MATERIAL_WORDS = r"证明材料|证书|业绩证明|合同|中标通知书|社保|职称证|资格证|营业执照|财务报告|审计报告|人员配置表|监理大纲|身份证|学历证"
DEMAND = r"须|应|需|提供|具备|具有"
EDGE = " ：:，,。()（）"


def _edged(c: F.Column, chars: str = EDGE) -> F.Column:
    return F.regexp_replace(c, f"^[{chars}]+|[{chars}]+$", "")


def category_line(c: F.Column) -> F.Column:
    """Whether a line opens a category: its words and a score; a numbered line only with the category's total."""
    numbered = ~c.rlike(PER_ITEM) & c.rlike(CATEGORY_TOTAL)
    return c.rlike(CATEGORY_WORDS) & c.rlike(SCORE) & (~c.rlike(ITEM_PREFIX) | numbered)


def category_name(c: F.Column) -> F.Column:
    s = F.trim(F.regexp_replace(F.trim(F.regexp_replace(c, ITEM_PREFIX, "")), CATEGORY_NOTE, ""))
    return _edged(F.regexp_replace(s, SCORE, ""))


def line_score(c: F.Column) -> F.Column:
    """The full score of a line, else its first; over 100 is none."""
    full, first = F.regexp_extract(c, FULL_SCORE, 1), F.regexp_extract(c, SCORE, 1)
    value = F.coalesce(F.nullif(full, F.lit("")), F.nullif(first, F.lit(""))).cast("double")
    return F.when(value <= 100, value)


def item_name(c: F.Column) -> F.Column:
    """A score item's name: without number, scores and what leads to them; null if nothing or over 60 characters are left."""
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, ITEM_PREFIX, ""), PER_ITEM, ""), SCORE, "")
    s = _edged(F.regexp_replace(s, r"(?:满分|共|总计|合计)\s*", ""))
    return F.when(F.length(s).between(1, 60), s)


def materials(c: F.Column) -> F.Column:
    """Names of the evidence that a line asks for: after words that lead to them, then in brackets; each once, in order."""

    def parts(pattern: str, edge: str) -> F.Column:
        chunks = F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
        names = F.flatten(F.transform(chunks, lambda x: F.split(x, "[、，,；;]")))
        return F.filter(F.transform(names, lambda x: _edged(F.trim(x), edge)), lambda x: x.rlike(MATERIAL_WORDS))

    return F.array_distinct(F.concat(parts(MATERIAL_LEAD, "（）()。"), parts(MATERIAL_BRACKET, "。")))


def score_items(lines: DataFrame, key: str, order: str, text: str = "text") -> DataFrame:
    """(key, order, category, name, score, materials, thresholds, unrecognized) of the items of score sections.

    Items belong to the last category line before them; lines before the first one go, but a section without any
    category is one, 未分类. A demand without a threshold is kept as unrecognized text.
    """
    rows = lines.withColumn("line", F.trim(F.col(text))).withColumn("opens", category_line(F.col("line")))
    rows = rows.withColumn("any", F.max("opens").over(Window.partitionBy(key))).withColumn("own", F.when(F.col("opens"), category_name(F.col("line"))))
    # A section without categories has one on every line; else the last one carries on.
    rows = carried(rows.withColumn("own", F.when(F.col("any"), F.col("own")).otherwise("未分类")), key, order, "own")
    items = rows.where(~F.col("opens")).select(key, order, "line", "category", item_name(F.col("line")).alias("name"), line_score(F.col("line")).alias("score")).where("name is not null and score is not null")
    demand = (F.size("thresholds") == 0) & F.col("line").rlike(DEMAND) & (F.length("line") > 15)
    items = items.withColumns({"materials": materials(F.col("line")), "thresholds": T.thresholds(F.col("line"))})
    return items.withColumn("unrecognized", F.when(demand, F.substring("line", 1, 200)).otherwise("")).drop("line")


def totals(items: DataFrame, key: str) -> DataFrame:
    """Per table: categories with items, their sum and whether that is 100."""
    per = items.groupBy(key, "category").agg(F.sum("score").alias("subtotal"), F.count("*").alias("items"))
    return per.groupBy(key).agg(F.count("*").alias("categories"), F.sum("subtotal").alias("total"), (F.abs(F.sum("subtotal") - 100) < 0.01).alias("is_100"))


def score_faults(table: F.Column) -> F.Column:
    """Sorted list of what a score table (struct of total, expected, items array of struct(name, score)) gets wrong."""
    bad = F.array(
        F.when(F.size(table["items"]) == 0, "items: none"),
        F.when(F.exists(table["items"], lambda x: F.coalesce(F.trim(x["name"]), F.lit("")) == ""), "name: empty"),
        F.when(F.exists(table["items"], lambda x: ~F.coalesce(x["score"].between(0, 100), F.lit(False))), "score: out of 0..100"),
        F.when(F.abs(table["total"] - table["expected"]) >= 0.01, "total: not as expected"),
    )
    return F.array_sort(F.filter(bad, lambda x: x.isNotNull()))
