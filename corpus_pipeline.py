"""The corpus pipeline: five stages, each calling one operator on all that its predecessor kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next one's docs. All but the last return the columns of
`documents`; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldloom.llm import decontamination, jaccard_join, packing, pii, quality_classifier
from fieldloom.llm.common import stash, table

#: SQL can't express the classifier, the trees, the tokenizer: tests/llm holds the stages against brute force.
ORACLE_SQL = None


def _wrapped(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the whole row as one column, so that no column's name can clash with an operator's."""
    return docs.select("doc_id", "text", F.struct(*[F.col(c) for c in docs.columns]).alias("__row"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    scored = quality_classifier.score_documents(_wrapped(docs), table(spark, sf_dir, "labels"))
    return scored.filter(F.col("score") >= quality_classifier.THRESHOLD).select("__row.*")


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with `__key`: the doc_id, or where there is none a negative hash of the text."""
    none = F.xxhash64("text").bitwiseOR(F.lit(-(1 << 63)))
    return docs.withColumn("__key", F.coalesce(F.col("doc_id").cast("long"), none))


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates (five-word shingles, similarity 0.8): that with the smallest key, once.

    Rows without an id are documents by their text, and go first; a null, empty or blank text is a class
    of its own; rows that share an id are one document, of which equal texts stay once.
    """
    keyed = _keyed(docs)
    classes = jaccard_join.join(keyed.select(F.col("__key").alias("doc_id"), "text"), words=5, percent=80)
    others = classes.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__key")).distinct()
    one = keyed.join(others, "__key", "left_anti").withColumn("__text", F.xxhash64("text"))
    return one.dropDuplicates(["__key", "__text"]).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that give no benchmark item away; rows that share an id go together, those without one by their text."""
    keyed = _keyed(docs)
    leaks = decontamination.find_leaks(keyed.select(F.col("__key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return keyed.join(leaks.select(F.col("doc_id").alias("__key")).distinct(), "__key", "left_anti").select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind's name."""
    redacted = pii.redact(_wrapped(docs), pii.fit(docs.select("doc_id", "text")))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return redacted.select(*[new.get(c, F.col(f"__row.{c}")).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed by source."""
    import public_tokenizers

    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "source", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_classifier", keep_good),
    ("jaccard_join", keep_one_of_each_class),
    ("decontamination", drop_leaks),
    ("pii", redact_personal_data),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stash(docs, name)
    return docs
