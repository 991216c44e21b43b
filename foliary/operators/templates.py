"""Template matching, association and placeholder audits."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from foliary.functions import text as T

# Weights of a template's score.
WEIGHTS = {"names": 50, "count": 20, "order": 15, "agency": 50, "doc_type": 25}


@F.pandas_udf(IntegerType())
def common_subsequence(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Length of the longest common subsequence of two arrays; one NumPy pass for each element of the first."""
    for left, right in pairs:
        out = []
        for a, b in zip(left, right, strict=True):
            b = np.asarray(b, dtype=object)
            row = np.zeros(len(b) + 1, np.int32)
            for x in a:
                step = row.copy()
                step[1:] = np.maximum(row[1:], row[:-1] + (b == x))
                row = np.maximum.accumulate(step)
            out.append(int(row[-1]))
        yield pd.Series(out, dtype="int32")


@F.pandas_udf(DoubleType())
def rounded(values: pd.Series, digits: pd.Series) -> pd.Series:
    """Half to even on the double itself (0.15 to one place is 0.1), which neither round nor bround does."""
    return pd.Series([None if v != v else round(v, int(d)) for v, d in zip(values, digits, strict=True)], dtype="float64")


def similarity(parse: Column, template: Column, agency: Column, doc_type: Column) -> Column:
    """struct(score, match_rate, count_ratio, order_score) of two lists of chapter names; names compare by chapter key.

    The match rate is of the parsed names. A list without names adds nothing; the two flags count all the same.
    """
    keys = lambda names: F.transform(F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda x: x != ""), T.chapter_key)
    a, b = keys(parse), keys(template)
    n, m = F.size(a), F.size(b)
    some = (n > 0) & (m > 0)
    ratio = lambda x, of: F.when(some, x / of).otherwise(0.0)
    match = ratio(F.size(F.filter(a, lambda x: F.array_contains(b, x))), n)
    count = ratio(F.least(n, m), F.greatest(n, m))
    order = ratio(common_subsequence(a, b), F.greatest(n, m))
    total = match * WEIGHTS["names"] + count * WEIGHTS["count"] + order * WEIGHTS["order"] + F.when(agency, WEIGHTS["agency"]).otherwise(0) + F.when(doc_type, WEIGHTS["doc_type"]).otherwise(0)
    return F.struct(rounded(F.least(F.lit(100.0), total), F.lit(1)).alias("score"), match.alias("match_rate"), count.alias("count_ratio"), order.alias("order_score"))


def best_templates(scored: DataFrame, key: str, top: int = 10, least: float = 90.0) -> DataFrame:
    """The ``top`` templates of each key by score, ties by their order (pos); is_best marks the first if it reaches ``least``."""
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "pos"))).where(F.col("rank") <= top)
    return ranked.withColumn("is_best", (F.col("rank") == 1) & (F.col("score") >= least))


def associated(parse: DataFrame, template: DataFrame, key: str) -> DataFrame:
    """Parsed chapters (key, pos, name) with the template's chapter of the same name (its last), else of the same place."""
    named = template.withColumn("chapter_key", T.chapter_key(F.col("name"))).groupBy(key, "chapter_key").agg(F.max_by("name", "pos").alias("by_name"))
    placed = template.select(key, "pos", F.col("name").alias("by_place"))
    rows = parse.withColumn("chapter_key", T.chapter_key(F.col("name"))).join(named, [key, "chapter_key"], "left").join(placed, [key, "pos"], "left")
    return rows.select(key, "pos", "name", F.coalesce("by_name", "by_place").alias("template"), F.when(F.col("by_name").isNotNull(), "name").when(F.col("by_place").isNotNull(), "place").otherwise("none").alias("how"))


def coverage(texts: DataFrame, dictionary: DataFrame, key: str) -> DataFrame:
    """(key, name) of placeholders that the dictionary lacks."""
    return texts.select(key, F.explode(T.placeholders(F.col("text"))).alias("name")).join(dictionary.select("name").distinct(), "name", "left_anti")


def decided(candidates: DataFrame, field: str, value: str, order: list[str]) -> DataFrame:
    """One value a field: the only candidate, or the first of several with a flag."""
    return candidates.groupBy(field).agg(F.min_by(value, F.struct(*order)).alias("value"), (F.count_distinct(value) > 1).alias("needs_manual"))


def inconsistent(values: DataFrame, field: str, chapter: str, value: str) -> DataFrame:
    """Fields with more than one value over chapters."""
    return values.groupBy(field).agg(F.count_distinct(value).alias("n_values"), F.count_distinct(chapter).alias("n_chapters")).where("n_values > 1")


#: Kinds of first bytes of terms that are written into the plan at most.
INLINE = 2_000


def holding(texts: DataFrame, key: str, text: Column, terms: DataFrame, term: Column, most: int = 32) -> DataFrame:
    """(key, term, text): terms that the texts contain; ``key`` names a text.

    A term's first bytes, as many as the shortest term has (``most`` at most), are looked for by their hash at every
    place of the texts, and what meets is checked in full. Up to INLINE kinds of first bytes go along with the plan, so a
    text's other places never become rows; more are joined, a row for each distinct place.
    """
    words = terms.select(term.alias("term")).where("term <> ''").distinct()
    shortest = words.agg(F.min(F.octet_length("term"))).first()[0] or 1
    size = min(most, shortest)
    keyed = words.withColumn("gram", F.xxhash64(F.substring(F.col("term").cast("binary"), 1, size)))
    rows = texts.select(F.col(key), text.alias("text"))
    # Bytes, not characters: a place in a text is found without reading up to it. As an array's one element they are
    # a variable, which is bound once and not read from the row for every place.
    places = F.sequence(F.lit(1), F.octet_length("text") - size + 1)
    grams = F.flatten(F.transform(F.array(F.col("text").cast("binary")), lambda raw: F.transform(places, lambda i: F.xxhash64(F.substring(raw, i, F.lit(size))))))
    few = keyed.select("gram").distinct().limit(INLINE + 1).collect()
    if len(few) <= INLINE:
        hashes = [r["gram"] for r in few]
        grams = F.filter(grams, lambda g: g.isin(hashes))
    met = rows.where(F.octet_length("text") >= size).select(key, F.explode(F.array_distinct(grams)).alias("gram")).join(keyed, "gram").select(key, "term")
    return met.join(rows, key).where(F.contains("text", "term")).select(key, "term", "text")


def occurrences(texts: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """(key, term, n) of terms that occur, counted without overlap; ``key`` names a text."""
    return holding(texts, key, F.col("text"), terms, F.col("term")).select(key, "term", ((F.length("text") - F.length(F.replace("text", F.col("term"), F.lit("")))) / F.length("term")).cast("long").alias("n"))


# Words of each kind of document, and fields that must agree, with the words before their values.
KIND_WORDS = {"bid": ("投标人", "招标人", "招标", "投标"), "procurement": ("供应商", "采购人", "采购", "供应"), "quotation": ("供应商", "询价人", "询价", "报价")}
AGREEING = {"enterprise_name": "企业名称", "project_number": "项目编号", "legal_representative": "法定代表人", "authorized_agent": "委托代理人"}
# Where the fields of materials stand in recognised text.
VALUE_RULES = {
    "personnel_name": r"姓\s*名[：:\s]*(\S+)",
    "personnel_id_number": r"身份证[号号码]*[：:\s]*(\d{15,18}[Xx]?)",
    "personnel_title": r"职称[：:\s]*(\S+)",
    "personnel_cert_number": r"证书编号[：:\s]*(\S+)",
    "personnel_position": r"职务[：:\s]*(\S+)",
    "performance_project_name": r"项目名称[：:\s]*(\S+)",
    "performance_contract_amount": r"合同金额[：:\s]*([0-9,，.]+万元?)",
    "performance_contract_date": r"签订日期[：:\s]*(\d{4}[-/年]\d{1,2}[-/月]\d{1,2})",
    "performance_owner": r"建设单位[：:\s]*(\S+)",
    "performance_supervisor": r"总监[：:\s]*(\S+)",
    "qualification_name": r"资质名称[：:\s]*(\S+)",
    "qualification_level": r"等级[：:\s]*(\S+)",
    "qualification_cert_number": r"证书编号[：:\s]*(\S+)",
    "qualification_valid_until": r"有效期至[：:\s]*(\d{4}[-/年]\d{1,2}[-/月]\d{1,2})",
}


def values(texts: DataFrame, key: str) -> DataFrame:
    """(key, field, pos, value): every match of every rule in the texts, in their order."""
    found = F.map_from_arrays(F.array(*[F.lit(k) for k in VALUE_RULES]), F.array(*[F.regexp_extract_all("text", F.lit(f"(?U){p}"), F.lit(1)) for p in VALUE_RULES.values()]))
    return texts.select(key, F.explode(found).alias("field", "found")).select(key, "field", F.posexplode("found").alias("pos", "value"))


def forbidden(kind: Column) -> Column:
    """Words of other kinds that a document of this kind must not use, in order."""
    every = lambda names: F.array(*[F.lit(w) for n in names for w in KIND_WORDS[n]]).cast("array<string>")
    out = F.when(F.lit(False), every(()))
    for k in KIND_WORDS:
        out = out.when(kind == k, F.array_except(every([n for n in KIND_WORDS if n != k]), every([k])))
    return out.otherwise(F.array_distinct(every(KIND_WORDS)))


def agreeing_fields(texts: DataFrame, key: str) -> DataFrame:
    """(key, field, value): the first value of each field that must agree over chapters."""
    found = [F.struct(F.lit(k).alias("field"), F.regexp_extract("text", rf"(?U){w}[：:\s]+(\S+)", 1).alias("value")) for k, w in AGREEING.items()]
    return texts.select(key, F.inline(F.array(*found))).where("value <> ''")


def display(value: Column, manual: Column, name: Column) -> Column:
    """What a reader sees: the value if it is settled, else that it is missing."""
    return F.when(value.isNotNull() & ~manual, value).otherwise(F.concat(F.lit("【缺失："), name, F.lit("】")))


def context(*sources: tuple[DataFrame, str]) -> DataFrame:
    """(key, name, value) of several (rows of key, name, value; label): a later source's value wins, and its label is kept."""
    rows = [df.select("key", "name", "value", F.lit(label).alias("source"), F.lit(k).alias("rank")) for k, (df, label) in enumerate(sources)]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    return every.where("value is not null").groupBy("key", "name").agg(F.max_by(F.struct("value", "source"), "rank").alias("v")).select("key", "name", "v.*")


def render_plan(chapters: DataFrame, order: DataFrame, before: DataFrame) -> DataFrame:
    """Chapters (project, chapter, idx, name) with their place from ``order`` (project, chapter, seq), else by position, and
    what users have settled before (project, chapter, name, value, manual)."""
    rows = chapters.join(order, ["project", "chapter"], "left").join(before, ["project", "chapter", "name"], "left")
    return rows.select("project", "chapter", "name", F.coalesce("seq", "idx").alias("seq"), "value", F.coalesce("manual", F.lit(False)).alias("manual"))


def warnings(plan: DataFrame) -> DataFrame:
    """plan (chapter, name, type, missing, manual) to (chapter, name, problem)."""
    problem = F.when(F.col("missing") & (F.col("type") == "image"), "missing_image").when(F.col("missing"), "missing_text").when(F.col("manual"), "b_class_uncertain")
    return plan.select("chapter", "name", problem.alias("problem")).where("problem is not null")


def compliance(texts: DataFrame, key: str) -> DataFrame:
    """(key, issues, names, ok): what is wrong with each template: absent, empty, or each error of its syntax."""
    empty = F.when(F.col("text").isNull(), F.array(F.lit("absent"))).when(F.trim("text") == "", F.array(F.lit("empty")))
    issues = F.coalesce(empty, T.syntax_errors(F.col("text")))
    return texts.select(key, issues.alias("issues"), F.coalesce(T.placeholders(F.col("text")), F.array().cast("array<string>")).alias("names")).withColumn("ok", F.size("issues") == 0)


def table_shape(rows: Column) -> Column:
    """struct(rows, columns) of an array of rows of cells."""
    return F.struct(F.size(rows).alias("rows"), F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0)).alias("columns"))


def mechanical(pairs: DataFrame, tolerance: int = 0) -> DataFrame:
    """pairs (a_text, b_text) with placeholder counts, table shapes, and whether they differ too much (red_flag)."""
    n = lambda c: F.regexp_count(c, F.lit(r"\{\{\w+\}\}"))
    a, b = (table_shape(T.markdown_rows(F.col(c))) for c in ("a_text", "b_text"))
    rows = pairs.withColumns({"a_names": n(F.col("a_text")), "b_names": n(F.col("b_text")), "a_table": a, "b_table": b})
    return rows.withColumn("red_flag", (F.abs(F.col("a_names") - F.col("b_names")) > tolerance) | (F.col("a_table") != F.col("b_table")))


@F.arrow_udf(IntegerType())
def changed_lines(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Lines of a unified diff that start with + or -, but for +++; null where both texts are. One pair at a time is text."""
    for left, right in pairs:
        out = []
        for a, b in zip(left, right, strict=True):
            if not a.is_valid and not b.is_valid:
                out.append(None)
                continue
            lines = difflib.unified_diff((a.as_py() or "").splitlines(), (b.as_py() or "").splitlines(), lineterm="")
            out.append(sum(x.startswith(("+", "-")) and not x.startswith("+++") for x in lines))
        yield pa.array(out, pa.int32())
        pa.default_memory_pool().release_unused()


#: What ends a line for the diff.
BREAK = r"[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def changes(a: Column, b: Column) -> Column:
    """changed_lines; null texts are empty. Two texts of a line or none each need no diff and hand Python no text: equal ones
    have no changes, others the header's line and a line for each that isn't empty, but that +++ doesn't count."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    line = lambda c: (c != "").cast("int")
    single = ~a.rlike(BREAK) & ~b.rlike(BREAK)
    settled = F.when(a == b, 0).when(single, 1 + line(a) + line(b) - F.startswith(b, F.lit("++")).cast("int"))
    return F.coalesce(settled, changed_lines(F.when(settled.isNull(), a), F.when(settled.isNull(), b)))


def findings(parse: DataFrame, template: DataFrame, key: str, pairs: int = 50) -> DataFrame:
    """Differences of paragraphs (key, pos, text) at equal places up to ``pairs``: (key, pos, changes, confidence)."""
    both = parse.where(F.col("pos") < pairs).select(key, "pos", F.col("text").alias("a")).join(template.select(key, "pos", F.col("text").alias("b")), [key, "pos"])
    # Equal texts go first, so they never reach the diff.
    rows = both.where("not a <=> b").withColumn("changes", changes(F.col("a"), F.col("b"))).where("changes > 0")
    return rows.select(key, "pos", "changes", F.when(F.col("changes") < 5, "high").otherwise("low").alias("confidence"))


# Chapters that are replaced as a whole.
WHOLE = ("投标函", "报价函", "开标一览表", "投标报价")


def comparison(associations: DataFrame, parsed: DataFrame, template: DataFrame, key: str, pairs: int = 50, tolerance: int = 0) -> DataFrame:
    """All findings of parsed chapters against a template: (key, chapter, kind, place, changes, confidence, action, red_flag, disclosure).

    associations (key, chapter, template, null where none), parsed and template (key, chapter, pos, text). ``unmatched``: a
    chapter without a counterpart (manual_review), and a template chapter that none has (keep); ``mechanical``: placeholder
    counts or table shapes differ (a red flag); ``paragraph``: texts at equal places up to ``pairs`` differ, sure below
    five changed lines. Where a chapter is one that is replaced as a whole and its paragraphs aren't the template's, its
    last finding says so and asks for disclosure. Chapters without paragraphs have no findings but ``unmatched``.
    """
    named = associations.select(key, "chapter", "template")
    finding = lambda kind, place, changes, confidence, action, red: [F.lit(kind).alias("kind"), place.cast("int").alias("place"), changes.cast("int").alias("changes"), confidence.alias("confidence"), action.alias("action"), F.lit(red).alias("red_flag")]
    none, sure = F.lit(None), F.lit("high")
    lone = named.where("template is null").select(key, "chapter", *finding("unmatched", none, none, sure, F.lit("manual_review"), False))
    used = named.where("template is not null").select(key, F.col("template").alias("chapter"))
    extra = template.select(key, "chapter").distinct().join(used, [key, "chapter"], "left_anti").select(key, "chapter", *finding("unmatched", none, none, sure, F.lit("keep"), False))

    def whole(paragraphs: DataFrame, name: str) -> DataFrame:
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"])
        return paragraphs.groupBy(key, F.col("chapter").alias(name)).agg(ordered.alias(f"{name}_texts"))

    both = named.where("template is not null").join(whole(parsed, "chapter"), [key, "chapter"]).join(whole(template, "template"), [key, "template"])
    both = both.withColumns({"a_text": F.array_join("chapter_texts", "\n"), "b_text": F.array_join("template_texts", "\n")})
    checked = mechanical(both, tolerance).where("red_flag")
    action = F.when(F.col("a_table") != F.col("b_table"), "manual_review").otherwise("update")
    flagged = checked.select(key, "chapter", *finding("mechanical", none, none, sure, action, True))
    placed = named.where("template is not null").join(parsed, [key, "chapter"]).where(F.col("pos") < pairs).select(key, "chapter", "template", "pos", F.col("text").alias("a"))
    placed = placed.join(template.select(key, F.col("chapter").alias("template"), "pos", F.col("text").alias("b")), [key, "template", "pos"]).where("not a <=> b").withColumn("n", changes(F.col("a"), F.col("b"))).where("n > 0")
    differing = placed.select(key, "chapter", *finding("paragraph", F.col("pos"), F.col("n"), F.when(F.col("n") < 5, "high").otherwise("low"), F.lit("update"), False))
    found = flagged.unionByName(differing)
    replaced = both.where(F.col("chapter").rlike("|".join(WHOLE)) & (F.col("chapter_texts") != F.col("template_texts"))).select(key, "chapter", F.lit(True).alias("whole"))
    last = F.row_number().over(Window.partitionBy(key, "chapter").orderBy(F.desc_nulls_last("place"))) == 1
    found = found.join(replaced, [key, "chapter"], "left").withColumn("disclosure", F.coalesce(F.col("whole") & last, F.lit(False)))
    found = found.withColumn("action", F.when(F.col("disclosure"), "replace").otherwise(F.col("action"))).drop("whole")
    return found.unionByName(lone.unionByName(extra).withColumn("disclosure", F.lit(False)))
