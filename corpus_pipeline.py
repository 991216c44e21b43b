"""Corpus pipeline over ``documents``: low quality goes, one of each group of copies stays, repeats go, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.llm.common import remove, table, written
from foliary.llm.exact_dedup import exact_dedup
from foliary.llm.ngram_jaccard import ngram_jaccard_join
from foliary.llm.packing import best_fit_packing
from foliary.llm.quality import learn, quality_filter
from foliary.llm.suffix_dedup import suffix_array_dedup


#: Tells rows apart within a stage, whatever their doc_id.
ROW = "stage_row"
#: Bytes of a passage that goes wherever it repeats: what some fifty words have at least in an alphabetic script.
PASSAGE = 200


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with ROW, as a written table: the key of a row is the same whenever it is read."""
    return written(docs.withColumn(ROW, F.monotonically_increasing_id()))


def _only(keyed: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of keyed that found keeps."""
    return keyed.join(found.where("kept").select(F.col("row").alias(ROW)), ROW, "left_semi").select([c for c in keyed.columns if c != ROW])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what the classifier, learned on the labels that are not held out, scores under 0.3.

    Null texts score as empty ones; rows with null or repeated ids are scored each by itself; an empty table stays empty.
    """
    return quality_filter(docs, learn(docs, table(spark, sf_dir, "labels")))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for A-Z case, one row with the largest doc_id stays; a null doc_id is the smallest."""
    docs = _keyed(docs)
    return _only(docs, exact_dedup(docs, row_col=ROW))


def ngram_jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of Jaccard 0.75 or more reach, one row with the smallest doc_id stays, one without only if none has any."""
    docs = _keyed(docs)
    return _only(docs, ngram_jaccard_join(docs, row_col=ROW))


def suffix_array_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose what repeats of PASSAGE bytes cover; a document of which nothing is left goes. Each row is cut by itself, whatever its doc_id.

    Null texts stay as they are. Repeated rows cover each other and go; an empty table stays empty.
    """
    others = [c for c in docs.columns if c != "text"]
    found = suffix_array_dedup(docs, length=PASSAGE, carry=F.struct(F.col("text").isNull().alias("text"), *others)).where("n_removed = 0 or kept <> ''")
    own = {c: F.col("carried")[c] for c in others}
    own["text"] = F.when(~F.col("carried.text"), F.col("kept"))
    own["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(own["n_chars"])
    return found.select(*[own[c].alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 words: (doc_id, source, cluster, piece, size, bin, start)."""
    return best_fit_packing(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup_stage),
    ("n-gram Jaccard join", ngram_jaccard_stage),
    ("suffix-array dedup", suffix_array_stage),
    ("best-fit packing", packing_stage),
]

#: A learned classifier, repeats of bytes and best fit are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
            if before is not None:
                remove(before)
            before = docs
    return docs
