"""A training corpus from documents: toxicity, exact dedup, n-gram Jaccard join, PII, best-fit packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumicat.llm import exact_dedup, ngram_join, packing, pii, toxicity
from lumicat.llm.common import SPACE, materialise
from lumicat.llm.queries import table, vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the CRF doesn't find toxic, rows as they are; null and empty texts score low and stay."""
    return toxicity.reject_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def _free(docs: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``docs`` has."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name in taken:
            name = f"_{name}"
        taken.add(name)
        out.append(name)
    return out


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts; of rows that repeat an id and its text, one.

    Null texts count as empty, and of all empty ones one stays; rows without an id are rows like others.  Rows that share an id
    but not the text are told apart.  Other columns of any name stay as they are.
    """
    i, wanted, sha, n = _free(docs, "id", "wanted", "sha", "n")
    kept = exact_dedup.exact_dedup(docs).where("kept").select(F.col("doc_id").alias(i), F.col("text_sha256").alias(wanted))
    digest = F.sha2(F.translate(F.coalesce("text", F.lit("")), SPACE.decode(), "").cast("binary"), 256)
    same = F.col("doc_id").eqNullSafe(F.col(i))
    rows = docs.withColumn(sha, digest).join(kept, same & (F.col(sha) == F.col(wanted)), "left_semi")
    # only rows whose id occurs again have to meet: usually a tiny table, so that texts don't move a second time
    again = materialise(docs.groupBy(F.col("doc_id").alias(i)).agg(F.count("*").alias(n)).where(F.col(n) > 1).select(i), "repeated")
    twice = rows.join(again, same, "left_semi").dropDuplicates(["doc_id", sha])
    return rows.join(again, same, "left_anti").unionByName(twice).drop(sha)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the one with the smallest id.

    Documents without words link to nothing and stay.  Rows that share an id stay or go together; rows without an id stay where
    their component has none with one.  Other columns of any name stay as they are.
    """
    (i,) = _free(docs, "id")
    kept = ngram_join.ngram_jaccard_join(docs, n=5, num=75, den=100).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(i)).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(i)), "left_semi")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; ``n_chars``, where there is one, counts the new text.  Null texts stay null."""
    out = pii.redact(docs)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens in sequences: the columns of ``packing.pack_documents``, a piece a row at least for each row
    (null texts are empty documents of one token)."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), end_id=1, capacity=4096, special=True)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("ngram_jaccard_join", drop_near_copies), ("pii", mask_personal_data), ("best_fit_packing", pack)]

#: The stages with trained models and tokenizers can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
