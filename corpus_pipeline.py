"""From raw documents to training pieces: toxicity, near copies, benchmark passages, secrets, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. ``run`` writes each
result to the shared folder and reads it again for the next stage, so that a lost executor costs a
re-read. Stages that hand texts to Python workers ask for small Arrow batches, so that the batches of all
tasks of an executor, in the JVM and in the workers, fit beside its heap. All stages but the last return the columns of ``docs`` as they are, whatever further columns
there are; a missing text counts as empty, and a document without text stays unless it is a near copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfgrade.llm import decontaminate, pieces, queries, secret_scan, simhash, toxicity
from shelfgrade.staging import release, stage

# Not expressible in SQL: a trained classifier, hashed fingerprints, guess costs, a piece lattice.
ORACLE_SQL = None


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_MB = 8


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set(BATCH, f"{BATCH_MB}m")


def _whole(docs: DataFrame):
    """All columns of a row as one, so that no name can clash with an operator's."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at or above the toxicity threshold of their language go."""
    _small_batches(spark)
    learned = F.coalesce(queries.remainder("doc_id", 4) != 2, F.lit(False))
    labels = queries.table(spark, sf_dir, "labels").where(learned)
    model = toxicity.train(docs.where(learned), labels, "doc_id", "text", "lang", "toxic")
    scored = toxicity.score(docs.select(_whole(docs), "text", "lang"), model, "text", "lang", ["_doc"])
    return scored.where("flagged = 0").select("_doc.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    _small_batches(spark)
    return simhash.first_copies(docs, "doc_id", "text", shingle=3, radius=3)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    mark = F.struct(F.col("doc_id").alias("key"), F.xxhash64("text").alias("hash")).alias("_mark")
    found = decontaminate.contamination(docs.select(mark, "text"), queries.table(spark, sf_dir, "benchmark"), ["_mark"], size=queries.WINDOW)
    hit = found.where("n_hit > 0").select("_mark").distinct()
    return docs.select(mark, _whole(docs)).join(hit, "_mark", "left_anti").select("_doc.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; the number of characters follows."""
    _small_batches(spark)
    masked = secret_scan.redact(docs, "text")
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the ids of their best segmentation, and whether these give the text back."""
    _small_batches(spark)
    encoded = pieces.encode(docs.select(_whole(docs), "text"), "text", ["_doc"], queries.PIECES, n=2)
    return encoded.select("_doc.*", F.col("ids").alias("piece_ids"), "n_pieces", F.col("score").alias("piece_score"), "round_trip")


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", mask_secrets),
    ("sentencepiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = queries.table(spark, sf_dir, "documents"), None
    for name, step in STAGES:
        now = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
        if before:
            release(spark, before.path)
        docs, before = now.frame, now
    return docs
