"""Segmentation: lines and blocks to headings, tables of contents, chapter trees and page ranges."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliary.functions import text as T
from foliary.operators.walks import sorted_by


def blocks(docs: DataFrame, per_page: int = 20) -> DataFrame:
    """One row per line: doc_id, block_idx, page_idx, text (trimmed)."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_idx", "line"))
    return rows.select("doc_id", "block_idx", F.expr(f"cast(block_idx div {per_page} as int)").alias("page_idx"), F.trim("line").alias("text"))


def toc_pages(rows: DataFrame) -> DataFrame:
    """Pages that hold a table of contents: its title, or four headings or more of which half end in a page number."""
    like = T.heading(F.col("text")).isNotNull() | T.toc_line(F.col("text"))
    page = rows.groupBy("doc_id", "page_idx").agg(F.count_if(like).alias("headings"), F.count_if(T.toc_line(F.col("text"))).alias("leaders"), F.bool_or(F.col("text").rlike(r"^目[\s　]*录$")).alias("titled"))
    return page.where("titled or (headings >= 4 and leaders * 2 >= headings)").select("doc_id", "page_idx", "headings", "leaders")


def headings(rows: DataFrame, most_bare: int = 3) -> DataFrame:
    """Headings outside tables of contents; pages with ``most_bare`` or more bare level-1 headings lose them."""
    found = rows.join(toc_pages(rows).select("doc_id", "page_idx"), ["doc_id", "page_idx"], "left_anti").where(~T.body_noise(F.col("text"))).withColumn("h", T.heading(F.col("text"))).where("h is not null")
    found = found.select("doc_id", "block_idx", "page_idx", "h.*")
    bare = F.count_if((F.col("level") == 1) & (F.col("number") == "")).over(Window.partitionBy("doc_id", "page_idx"))
    return found.withColumn("bare", bare).where(f"not (level = 1 and number = '' and bare >= {most_bare})").drop("bare")


def without_running_headers(found: DataFrame, back: int = 8, pages: int = 3) -> DataFrame:
    """Drops a heading that repeats one of the last ``back`` kept ones within ``pages`` pages; what is kept depends on what was."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, kept = None, deque(maxlen=back)
        for batch in source:
            take = []
            for own, level, key, page in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "level", "key", "page_idx")), strict=True):
                if own != doc:
                    doc = own
                    kept.clear()
                # A heading without a level or page repeats none.
                known = level is not None and page is not None
                again = known and any(a == level and b == key and 0 <= page - c <= pages for a, b, c in kept if c is not None)
                take.append(not again)
                if not again:
                    kept.append((level, key, page))
            yield batch.filter(pa.array(take, pa.bool_()))

    keyed = found.withColumn("key", T.title_key(F.concat("number", "title")))
    return sorted_by(keyed, ["doc_id"], ["block_idx"]).mapInArrow(run, keyed.schema).drop("key")


def _frames(id_col: str, order: str):
    """The rows before and after each of a document. The later ones are read backwards, so both frames only ever grow and
    a row costs the same in a document of any length."""
    before = Window.partitionBy(id_col).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(id_col).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    return before, after


def tree(found: DataFrame, id_col: str = "doc_id", order: str = "block_idx", deepest: int = 8) -> DataFrame:
    """Parent (nearest earlier heading of a smaller level), sibling number and end page of each heading.

    Two window passes: for every level the last heading of it so far, and the next one to come, so no heading meets
    another in a join.
    """
    before, after = _frames(id_col, order)
    at = lambda k: F.when(F.col("level") == k, F.col(order))
    ups = [F.when(F.col("level") > k, F.last(at(k), True).over(before)) for k in range(1, deepest)]
    nexts = [F.when(F.col("level") >= k, F.last(F.when(F.col("level") == k, F.struct(F.col(order).alias("at"), F.col("page_idx").alias("page"))), True).over(after)) for k in range(1, deepest)]
    soonest = F.array_min(F.filter(F.array(*nexts), lambda x: x.isNotNull()))
    last = F.max("page_idx").over(Window.partitionBy(id_col))
    rows = found.select("*", F.greatest(*ups).alias("parent"), soonest.alias("next"), last.alias("last_page"))
    rows = rows.withColumn("end_page", F.when(F.col("next").isNull(), F.col("last_page")).otherwise(F.greatest("page_idx", F.col("next.page") - 1)))
    sibling = F.row_number().over(Window.partitionBy(id_col, "parent").orderBy(order))
    return rows.withColumn("seq", sibling).drop("next", "last_page")


def _open_above(found: DataFrame, id_col: str, order: str, carried: list[str], deepest: int) -> F.Column:
    """What is open above each row, outermost first: of each smaller level the last heading so far, as a struct of its
    order and the carried columns, unless a smaller level came after it and closed it."""
    before, _ = _frames(id_col, order)
    entry = F.struct(F.col(order).alias("at"), *carried)
    seen = [F.when(F.col("level") > k, F.last(F.when(F.col("level") == k, entry), True).over(before)) for k in range(1, deepest)]
    nearest = [F.greatest(F.lit(-1), F.lit(-1), *[F.coalesce(x["at"], F.lit(-1)) for x in seen[:k]]) for k in range(len(seen))]
    return F.filter(F.array(*[F.when(s["at"] > n, s) for s, n in zip(seen, nearest, strict=True)]), lambda x: x.isNotNull())


def numbered(found: DataFrame, id_col: str = "doc_id", order: str = "block_idx", title: str = "title", deepest: int = 8) -> DataFrame:
    """Headings with their place among siblings (seq), hierarchical number (``ch2.1.3``), path of titles from the top and
    depth. A level that is skipped has no number of its own: a heading counts under its nearest one of a smaller level."""
    rows = tree(found, id_col, order, deepest)
    rows = rows.withColumn("above", _open_above(rows, id_col, order, ["seq", title], deepest))
    number = F.concat(F.lit("ch"), F.array_join(F.transform(F.concat(F.col("above.seq"), F.array("seq")), lambda x: x.cast("string")), "."))
    path = F.array_join(F.concat(F.col(f"above.{title}"), F.array(F.col(title))), "/")
    return rows.withColumns({"chapter_id": number, "path": path, "depth": F.size("above")}).drop("above")


def repeated_short_lines(rows: DataFrame, most: int = 20) -> DataFrame:
    """Short lines on two pages or more: headers, footers and watermarks."""
    lines = rows.where((F.length("text") > 0) & (F.length("text") <= most))
    return lines.groupBy("doc_id", "text").agg(F.count_distinct("page_idx").alias("pages"), F.count("*").alias("lines")).where("pages >= 2")


def section_text(rows: DataFrame, sections: DataFrame, most: int = 20_000) -> DataFrame:
    """Text of each section's blocks; the join keeps the document as its key, so it is no nested loop."""
    s = sections.select("doc_id", F.col("block_idx").alias("start"), F.col("end_idx"))
    inside = rows.join(s, "doc_id").where("block_idx >= start and block_idx < end_idx and text <> ''")
    joined = inside.groupBy("doc_id", "start").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_idx", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return joined.withColumn("text", F.substring("text", 1, most))


def with_ancestors(found: DataFrame, id_col: str = "doc_id", order: str = "block_idx", deepest: int = 8) -> DataFrame:
    """Headings with the orders of all headings above them, nearest first."""
    return found.withColumn("ancestors", F.reverse(F.transform(_open_above(found, id_col, order, [], deepest), lambda x: x["at"])))
