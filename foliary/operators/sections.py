"""Section plans: which pages of a source each file of its format chapter takes, the blocks in them, and where headings stand."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliary.functions import text as T
from foliary.operators.walks import walked

# Titles of the format chapter and of its cover.
FORMAT_TITLE, COVER_TITLE = "投标文件格式", "封面"


def without_repeats(rows: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Rows that differ from the one before in one of the columns."""
    w = Window.partitionBy(key).orderBy(order)
    same = [F.col(c).eqNullSafe(F.lag(c).over(w)) for c in columns]
    repeat = (F.row_number().over(w) > 1) & same[0]
    for s in same[1:]:
        repeat = repeat & s
    return rows.withColumn("repeat", repeat).where("not repeat").drop("repeat")


def fallback_sections(headings: DataFrame, key: str = "source") -> DataFrame:
    """headings (source, block_idx, page_idx, text, first_page, last_page) as sections: each ends before the next starts."""
    rows = without_repeats(headings, key, "block_idx", ["page_idx", "text"])
    ends = F.lead("page_idx").over(Window.partitionBy(key).orderBy("block_idx")) - 1
    rows = rows.withColumn("ends", F.coalesce(ends, F.col("last_page")))
    return rows.select(
        key, "block_idx", F.col("text").alias("title"),
        F.greatest("first_page", F.least("page_idx", "last_page")).alias("start_page"),
        F.greatest("page_idx", F.least("ends", "last_page")).alias("end_page"),
    )


def section_plan(nodes: DataFrame, blocks: DataFrame) -> DataFrame:
    """(source, seq, title, kind, start_page, end_page) of all sources.

    nodes: chapter rows (source, pos, parent, title, start_page, end_page), parent the pos of the node above or null;
    blocks: (source, block_idx, page_idx, text, text_level). The first node whose title holds the format title is the
    format chapter. A cover, first below it and else anywhere, is 0. Its other children are 1, 2 ..; without children
    the headings on its pages are, and without those the chapter itself. Sources without the chapter have no rows.
    """
    keyed = nodes.withColumn("norm", T.title_key(F.col("title")))
    chapter = keyed.where(F.contains("norm", F.lit(FORMAT_TITLE))).groupBy("source").agg(F.min_by(F.struct("pos", "title", "norm", "start_page", F.greatest("start_page", "end_page").alias("end_page")), "pos").alias("f"))
    rows = keyed.join(chapter, "source")
    own = rows.where(F.col("parent") == F.col("f.pos"))
    cover = rows.where(F.col("norm") == COVER_TITLE).groupBy("source").agg(F.min_by(F.struct("pos", "start_page", F.greatest("start_page", "end_page").alias("end_page")), F.struct((~F.col("parent").eqNullSafe(F.col("f.pos"))).alias("far"), "pos")).alias("c"))
    covers = cover.select("source", F.lit(0).alias("seq"), F.lit(COVER_TITLE).alias("title"), F.lit("cover").alias("kind"), F.col("c.start_page").alias("start_page"), F.col("c.end_page").alias("end_page"))
    children = own.join(cover, "source", "left").where(F.col("c").isNull() | (F.col("pos") != F.col("c.pos")))
    numbered = lambda df, by: df.withColumn("seq", F.row_number().over(Window.partitionBy("source").orderBy(by)))
    body = numbered(children, "pos").select("source", "seq", "title", F.lit("section").alias("kind"), "start_page", F.greatest("start_page", F.coalesce("end_page", "f.end_page")).alias("end_page"))
    bare = chapter.join(body.select("source").distinct(), "source", "left_anti")
    heads = blocks.join(bare, "source").where("page_idx between f.start_page and f.end_page and text_level <= 2 and trim(text) <> ''")
    heads = heads.where(~((F.col("page_idx") == F.col("f.start_page")) & (T.title_key(F.col("text")) == F.col("f.norm"))))
    found = fallback_sections(heads.select("source", "block_idx", "page_idx", F.trim("text").alias("text"), F.col("f.start_page").alias("first_page"), F.col("f.end_page").alias("last_page")))
    found = numbered(found, "block_idx").select("source", "seq", "title", F.lit("section").alias("kind"), "start_page", "end_page")
    whole = bare.join(found.select("source").distinct(), "source", "left_anti").select("source", F.lit(1).alias("seq"), F.col("f.title").alias("title"), F.lit("section").alias("kind"), F.col("f.start_page").alias("start_page"), F.col("f.end_page").alias("end_page"))
    return covers.unionByName(body).unionByName(found).unionByName(whole)


def section_blocks(blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """Blocks on each section's pages (source, seq, block_idx ..), but for the heading that repeats its title on its first page.

    The source is the join's key, so the range of pages is a residual and no nested loop."""
    s = sections.select("source", "seq", "title", "start_page", "end_page")
    rows = blocks.join(s, "source").where("page_idx between start_page and end_page")
    title = (F.col("page_idx") == F.col("start_page")) & F.col("text_level").isNotNull() & (T.title_key(F.col("text")) == T.title_key(F.col("title")))
    return rows.where(~title).select("source", "seq", "block_idx", "page_idx", "text")


def located(headings: DataFrame, blocks: DataFrame, key: str = "source") -> DataFrame:
    """headings (source, pos, page_idx, text) with the block (source, block_idx, page_idx, text) in which each stands.

    Pages and normalised texts agree, and a block is never used again nor gone back behind. What was found before
    decides what can be found, so a source's candidates are walked in order; only blocks that match a heading take part.
    """
    h = headings.select(key, "pos", "page_idx", T.title_key(F.col("text")).alias("norm")).where("norm <> ''")
    b = blocks.select(key, "block_idx", "page_idx", T.title_key(F.col("text")).alias("norm"))
    met = h.join(b, [key, "page_idx", "norm"])

    def walk(rows: list[tuple]) -> Iterator[tuple]:
        cursor, last = -1, None
        for k, pos, block in rows:
            if block > cursor and (last is None or pos > last):
                cursor, last = block, pos
                yield k, pos, block

    kinds = dict(met.dtypes)
    return walked(met.select(key, "pos", "block_idx"), [key], ["pos", "block_idx"], walk, f"{key} {kinds[key]}, pos {kinds['pos']}, block_idx {kinds['block_idx']}")


def crosschecked(toc: DataFrame, body: DataFrame, key: str = "source") -> DataFrame:
    """(source, toc_count, matched): lines of a table of contents found in the body's titles, in order; both (source, pos, title).

    Titles match if they are equal once normalised, or one of four characters or more lies in the other. A match moves
    the cursor past it, so this is a walk over a source's titles; both lists are short by their nature.
    """

    def walk(rows: list[tuple]) -> Iterator[tuple]:
        wanted, names = ([norm for _, side, _, norm in rows if side == of] for of in (0, 1))
        cursor = matched = 0
        for want in wanted:
            at = next((k for k in range(cursor, len(names)) if names[k] == want or (len(want) >= 4 and want in names[k]) or (len(names[k]) >= 4 and names[k] in want)), -1)
            if at >= 0:
                matched, cursor = matched + 1, at + 1
        if wanted:
            yield rows[0][0], len(wanted), matched

    normal = lambda df, side: df.select(key, F.lit(side).alias("side"), "pos", F.coalesce(T.title_key(F.col("title")), F.lit("")).alias("norm"))
    return walked(normal(toc, 0).unionByName(normal(body, 1)), [key], ["side", "pos"], walk, f"{key} {dict(toc.dtypes)[key]}, toc_count long, matched long")


def subtree_spans(headings: DataFrame, key: str = "source", deepest: int = 8) -> DataFrame:
    """headings (source, block_idx, level, last_idx) with first and stop: the blocks after each until the next of its level or above."""
    # Read backwards: the frame then only grows, so a row costs the same in a source of any length.
    after = Window.partitionBy(key).orderBy(F.desc("block_idx")).rowsBetween(Window.unboundedPreceding, -1)
    nexts = [F.when(F.col("level") >= k, F.last(F.when(F.col("level") == k, F.col("block_idx")), True).over(after)) for k in range(1, deepest)]
    return headings.withColumn("first", F.col("block_idx") + 1).withColumn("stop", F.coalesce(F.least(*nexts), F.col("last_idx") + 1))


def block_counters(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Per section: paragraphs, tables, images and blocks without any text."""
    n = lambda kind: F.count_if(F.col("type") == kind)
    return blocks.groupBy(*keys).agg(n("text").alias("paragraphs"), n("table").alias("tables"), n("image").alias("images"), F.count_if(F.trim("text") == "").alias("empty"))


def crossing(objects: DataFrame, key: str) -> DataFrame:
    """Chapters with objects (obj, bbox) that reach over a page's edge, with those objects in order."""
    return objects.where(F.element_at("bbox", 4) < 0).groupBy(key).agg(F.array_sort(F.collect_list("obj")).alias("objects"))
