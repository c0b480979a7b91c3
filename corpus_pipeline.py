"""A corpus pipeline of five operators; each stage is written as Parquet and read as the next one's documents.

A document without id, of any stage, is kept where no decision names it. A null text counts as the empty text: it passes all
stages unless the toxicity machine rejects the empty text, as one fitted on toxic labels alone does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm import decontaminate, jaccard_join, pii, piece_codec, toxicity
from corpuslens.llm.common import saved, table

#: SQL cannot express the kernel machine; the operators of the stages are tested against brute-force versions, libraries or
#: held-out labels instead.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine does not reject."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.kept(docs, model)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: of its smallest id, the first text. Texts without words all stay."""
    found = jaccard_join.grouped(docs).withColumn("_row", jaccard_join.row_key(F.col("same")))
    keyed = docs.withColumn("_row", jaccard_join.row_key(jaccard_join.same_text()))
    kept = jaccard_join.with_small(keyed, found.where("NOT stays").select("_row"), "_row", "left_anti")
    again = found.where("stays AND n_shingles > 0").groupBy("_row").count().where("count > 1").select("_row")
    if not again.isEmpty():  # rows with one id and one text
        kept = jaccard_join.with_small(kept, again, "_row", "left_anti").unionByName(jaccard_join.with_small(kept, again, "_row", "left_semi").dropDuplicates(["_row"]))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.redacted(docs)


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, checked by decoding them."""
    import public_tokenizers

    return piece_codec.encode_checked(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("pii", without_personal_data),
    ("sentencepiece", as_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
