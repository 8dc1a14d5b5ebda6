"""From raw documents to token ids: toxic documents go, one of each near-duplicate group stays, benchmark overlaps go,
personal data is rewritten, and what remains is encoded.

Each stage is written as Parquet and read again, so none depends on the lineage of another. All but the last return the
columns of documents. No stage drops a document for missing or empty values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnbeck.llm import decontamination, near_duplicates, personal_data, piece_codec, toxicity
from tarnbeck.llm.common import table, written

#: Segments in each half of a worker's table in the last stage: the executor's heap is full by then, so workers get less than alone.
SEGMENTS = 50_000


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that score above 0.5 go; all stay without labels of both classes, and those without words do."""
    model = toxicity.fit(toxicity.labelled(docs, table(spark, sf_dir, "labels"), "toxic"))
    if not len(model[0]):
        return docs
    scored = toxicity.score(docs, model, keep_text=True, names=("__score", "__predicted"))
    wordless = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[A-Za-z0-9]|[^\x00-\x7F]")
    return scored.where((F.col("__score") <= 0.5) | wordless).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: the document with the smallest key of each group stays."""
    return near_duplicates.representatives(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that a benchmark item overlaps go."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def rewrite_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: personal data becomes its kind, terms that disclose it go; n_chars follows the text."""
    mine = docs.withColumnRenamed("spans", "__spans")
    out = personal_data.sanitised(mine)
    n_chars = F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*mine.columns).toDF(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: ids of each document and the text that they decode to, in place of the text."""
    import public_tokenizers

    return piece_codec.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), size=SEGMENTS)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("personal_data", rewrite_personal_data),
    ("sentencepiece", encode),
]
#: Learned scores, similarity search and the tokenizer are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, one after the other."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
