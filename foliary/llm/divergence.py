"""Source divergence audit (13): how far the sources of a language stand apart in the terms they use.

Each language keeps the terms of at least ``least`` of its documents. A group (language, source) gives each kept term the
smoothed share p = 1 + floor(10**9 * (count + 1) / (N + V)), and the divergence of two shares is floor((p - q)**2 / q).
Summed over all V kept terms for each pair of sources that would be V rows a pair; instead, by inclusion and exclusion
over the terms that a source has at all:

    sum = sum over a's terms of f(p, q0) + sum over b's terms of f(p0, q) + (V - |a| - |b|) * f(p0, q0)
          + sum over common terms of (f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0))

where p0, q0 are the shares of an absent term. The first two depend on counts alone and are priced from each group's
histogram of counts; the third is a constant; only the last needs postings, joined term by term in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliary.llm import textops
from foliary.llm.common import table, written

#: Documents that a kept term is in at least, scale of the shares, ranks of part ``term``.
LEAST, SCALE, RANKS = 3, 1_000_000_000, 200
#: Distinct (group, term) entries that a task gathers before it hands them on; postings of a block; salts of histogram rows.
FLUSH, BLOCK, SALTS = 200_000, 200_000, 32
#: Bytes of a term: A-Z, a-z and all of characters beyond ASCII.
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def term_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all terms, and the n + 1 term offsets of the documents."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _counted(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) gathered over many documents: occurrences, and documents that have the term."""
    held: dict[tuple[str, str], dict[bytes, list[int]]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in held.items():
            if terms:
                both = np.array(list(terms.values()), np.int64)
                n = len(terms)
                yield pa.record_batch([pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(list(terms), pa.binary()).cast(pa.string()), pa.array(both[:, 0]), pa.array(both[:, 1])], names=["lang", "source", "term", "n", "docs"])

    for batch in textops.batches(source, most=1 << 21):
        data, offsets = textops.utf8(batch.column(2), True)
        starts, ends, first = term_spans(data, offsets)
        if not len(starts):
            continue
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        groups = {g: k for k, g in enumerate(dict.fromkeys(zip(langs, sources, strict=True)))}
        doc = np.repeat(np.arange(len(langs)), np.diff(first))
        group = np.array([groups[g] for g in zip(langs, sources, strict=True)])[doc]
        hashes = textops.span_hashes(data, starts, ends)
        order = np.lexsort((doc, hashes, group))
        g, h, d = group[order], hashes[order], doc[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (h[1:] != h[:-1])
        own = new.copy()
        own[1:] |= d[1:] != d[:-1]
        at = np.flatnonzero(new)
        n, docs = np.diff(np.append(at, len(g))), np.add.reduceat(own.astype(np.int64), at)
        raw, names = data.tobytes(), list(groups)
        for k, i in enumerate(order[at].tolist()):
            entry = held.setdefault(names[group[i]], {}).setdefault(raw[starts[i] : ends[i]], [0, 0])
            size += not entry[0]
            entry[0] += int(n[k])
            entry[1] += int(docs[k])
        if size >= FLUSH:
            yield from flush()
            held, size = {}, 0
    yield from flush()


def postings(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(lang, source, term, n, lang_n, head) of the kept terms: occurrences in the group and in the language; head is true
    for one source of each term.

    Counts come together by (lang, source, term) after each task has added up its own, then a term's few sources meet.
    """
    counts = _named(docs, lang_col, source_col, text_col).mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    per = counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = Window.partitionBy("lang", "term")
    seen = per.withColumn("in_docs", F.sum("docs").over(whole)).withColumn("lang_n", F.sum("n").over(whole)).withColumn("head", F.col("source") == F.min("source").over(whole))
    return seen.where(F.col("in_docs") >= least).select("lang", "source", "term", "n", "lang_n", "head")


def _named(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(k) for c, k in zip(columns, ("lang", "source", "text"), strict=False)])


def share(n: F.Column, total: F.Column, terms: F.Column) -> F.Column:
    """1 + floor(10**9 * (n + 1) / (total + terms)); null without kept terms. Counts beyond a long's room go by decimals."""
    near = F.call_function("div", F.lit(SCALE) * (n + 1), total + terms)
    far = F.call_function("div", F.lit(SCALE).cast("decimal(12,0)") * (n.cast("decimal(20,0)") + 1), total + terms)
    return F.when(terms > 0, 1 + F.when(n < 9_000_000_000, near).otherwise(far))


def divergence(p: F.Column, q: F.Column) -> F.Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _exact(x: F.Column) -> F.Column:
    return F.sum(x.cast("decimal(38,0)"))


def _common(rows: pa.Table) -> pa.Table:
    """What the terms that both sources of a pair have add to the sums, for all pairs of a block's sources with common terms."""
    column = lambda k: rows.column(k).combine_chunks()
    term = column("term").dictionary_encode().indices.to_numpy()
    named = column("source").dictionary_encode()
    source, names = named.indices.to_numpy(), named.dictionary
    p, p0 = column("p").to_numpy(), column("p0").to_numpy()
    by_term = np.argsort(term, kind="stable")
    length = np.bincount(term)
    start = np.cumsum(length) - length
    absent = np.zeros(len(names), np.int64)
    absent[source] = p0
    f = lambda a, b: (a - b) * (a - b) // b
    one, two, value = [], [], []
    for a in range(len(names)):
        own = np.flatnonzero(source == a)
        n = length[term[own]]
        # The posting lists of a's terms, end to end.
        other = by_term[np.repeat(start[term[own]] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        pa_, pb, b = np.repeat(p[own], n), p[other], source[other]
        more = f(pa_, pb) - f(pa_, p0[other]) - f(absent[a], pb) + f(absent[a], p0[other])
        total = np.zeros(len(names), np.int64)
        np.add.at(total, b, more)
        met = np.unique(b[b != a])
        one += [a] * len(met)
        two.append(met)
        value.append(total[met])
    if not one:
        return pa.table({"lang": pa.array([], pa.string()), "source": pa.array([], pa.string()), "item": pa.array([], pa.string()), "value": pa.array([], pa.int64())})
    lang = rows.column("lang")[0].as_py()
    return pa.table({"lang": pa.array([lang] * len(one), pa.string()), "source": names.take(pa.array(one)), "item": names.take(pa.array(np.concatenate(two))), "value": pa.array(np.concatenate(value))})


def _met(rows: DataFrame, others: DataFrame) -> DataFrame:
    """rows (lang, ..) with each source of their language (others: lang, item, ..); salted, as languages are few."""
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    return dealt.join(others.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["lang", "salt"]).drop("salt").where("source <> item")


def source_divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = LEAST, ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank) for each group (lang, source) of docs.

    Part ``pair``: item is each other source of the language, value the divergence of the group from it over all kept
    terms, all ranks. Part ``term``: the kept terms that the group has and uses more than its language does, value the
    divergence of the group's share from the language's, the first ``ranks``. Ranks go by value descending, then by item.

    Null text, lang and source count as ''; a group without terms, with empty texts only or in a language that keeps no
    term still has its pairs (value 0 where nothing is kept). Repeated rows are documents of their own; ids and other
    columns, whatever their names, are not read. An empty table gives no rows. Whole numbers throughout; a pair's sum
    must fit a long.
    """
    kept = written(postings(docs, lang_col, source_col, text_col, least))
    groups = _named(docs, lang_col, source_col).distinct()
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("terms"))
    langs = kept.groupBy("lang").agg(F.count_if("head").alias("v"), F.sum("n").alias("lang_total"), F.count("*").alias("postings"))
    found = groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "terms", "v", "lang_total", "postings"])
    stats = written(found.withColumn("p0", share(F.lit(0).cast("long"), F.col("total"), F.col("v"))))
    named = stats.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("terms").alias("item_terms"))
    # Terms that one side has, by how many of its terms occur how often.
    histogram = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("kinds")).join(stats, ["lang", "source"])
    priced = _met(histogram.select("lang", "source", "kinds", share(F.col("n"), F.col("total"), F.col("v")).alias("p")), named)
    own = F.struct("source", "item", (F.col("kinds") * divergence(F.col("p"), F.col("q0")).cast("decimal(20,0)")).alias("value"))
    turned = F.struct(F.col("item").alias("source"), F.col("source").alias("item"), (F.col("kinds") * divergence(F.col("q0"), F.col("p")).cast("decimal(20,0)")).alias("value"))
    sided = priced.select("lang", F.inline(F.array(own, turned))).select("lang", "source", "item", F.col("value").cast("decimal(38,0)").alias("value"))
    # Terms that both sides have, from postings in blocks of terms.
    blocks = kept.join(stats, ["lang", "source"]).select("lang", F.expr(f"cast(pmod(xxhash64(term), postings div {BLOCK} + 1) as int)").alias("block"), "source", "term", share(F.col("n"), F.col("total"), F.col("v")).alias("p"), "p0")
    common = blocks.groupBy("lang", "block").applyInArrow(_common, "lang string, source string, item string, value long").select("lang", "source", "item", F.col("value").cast("decimal(38,0)").alias("value"))
    # Terms that neither side has, as if no term were common, and the pairs themselves.
    pairs = _met(stats.select("lang", "source", "terms", "v", "p0"), named)
    rest = F.coalesce((F.col("v") - F.col("terms") - F.col("item_terms")) * divergence(F.col("p0"), F.col("q0")).cast("decimal(20,0)"), F.lit(0))
    constant = pairs.select("lang", "source", "item", rest.cast("decimal(38,0)").alias("value"))
    summed = constant.unionByName(sided).unionByName(common).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pair = summed.select("lang", "source", F.lit("pair").alias("part"), "item", "value", place.alias("rank"))
    used = kept.join(stats, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), share(F.col("n"), F.col("total"), F.col("v")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q"))
    more = used.where("p > q").select("lang", "source", "item", divergence(F.col("p"), F.col("q")).alias("value"))
    term = more.withColumn("rank", place).where(F.col("rank") <= ranks).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pair.unionByName(term)


def op13_source_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
g AS (SELECT DISTINCT lang, source FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS lang_n FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT *, CAST(sum(n) OVER (PARTITION BY lang, source) AS BIGINT) AS total, count(*) OVER (PARTITION BY lang, source) AS v, CAST(sum(lang_n) OVER (PARTITION BY lang, source) AS BIGINT) AS lang_total FROM f),
x AS MATERIALIZED (SELECT lang, source, term, n, 1 + 1000000000 * (n + 1) // (total + v) AS p, 1 + 1000000000 * (lang_n + 1) // (lang_total + v) AS q FROM s),
m AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value FROM x a JOIN x b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(m.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN m ON m.lang = a.lang AND m.source = a.source AND m.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM x WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
"""
