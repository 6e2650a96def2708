"""A corpus pipeline: rejects poor and toxic documents, drops near copies, mixes sources, encodes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tiltmeter.llm import minhash_hamming, nbsvm_quality, prefix_bpe, temperature_mix, toxic_segments
from tiltmeter.llm.queries import piece_model
from tiltmeter.llm.shared import broadcast_if_small, stored


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


#: Whole texts that a Python worker gets at once in stages that hand it every text.
TEXT_ROWS = 500


def _few_texts_at_once(spark: SparkSession) -> None:
    """Bound the texts in flight between Spark and its workers, for this session: a stage's rows are written after it returns."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXT_ROWS)


#: Columns that the stages read; all others are carried under neutral names, so that none can clash.
READ = ("doc_id", "text", "source")


def _carried(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``stage`` applied to ``docs``, with exactly the columns of ``docs`` afterwards."""
    name = {c: c if c in READ else f"__c{i}" for i, c in enumerate(docs.columns)}
    return stage(docs.withColumnsRenamed(name)).select(*[F.col(n).alias(c) for c, n in name.items()])


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold.

    Null and empty texts are scored as texts without features, repeated rows are judged each (equal texts alike),
    an empty table gives no rows, null ids are never learned from, and all other columns come through unchanged.
    """
    _few_texts_at_once(spark)
    return _carried(docs, lambda d: nbsvm_quality.classify(d, _labels(spark, sf_dir)).where("predicted = 1"))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold.

    Null and empty texts have no toxic passage and get the score of the offset alone; repeated rows, empty tables,
    null ids and other columns are treated as in ``good_quality``.
    """
    _few_texts_at_once(spark)
    return _carried(docs, lambda d: toxic_segments.classify(d, _labels(spark, sf_dir)).where("predicted = 0"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; of rows that repeat an id, the one with the least text.

    An id names one document: texts that share an id are linked through it. Rows with a null id, and null, empty
    and white-space texts, are linked with nothing and stay; an empty table gives no rows.
    """
    found = stored(minhash_hamming.near_duplicates(docs), "pipeline-classes")
    dropped = stored(found.where("not kept").select("doc_id").distinct(), "pipeline-dropped")
    kept = docs.join(broadcast_if_small(dropped), "doc_id", "left_anti")
    again = stored(
        found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"),
        "pipeline-repeated",
    )
    if not again.isEmpty():
        first = Window.partitionBy("doc_id").orderBy(F.col("text"))
        single = kept.join(again, "doc_id").withColumn("__n", F.row_number().over(first)).where("__n = 1")
        kept = kept.join(again, "doc_id", "left_anti").unionByName(single.drop("__n"))
    return kept.select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows drawn to the target weights of the sources, as often as they are drawn.

    Null is a source of its own, sources without words lose their rows, repeated rows are drawn each, an empty
    table gives no rows, and all columns come through whatever their names.
    """
    return _carried(docs, temperature_mix.mix)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and digests of every row; a null or empty text has no ids; columns but ``doc_id`` and ``source`` end here."""
    _few_texts_at_once(spark)
    coded = prefix_bpe.encode_documents(docs.select("doc_id", "source", "text"), piece_model())
    return coded.select(
        "doc_id", "source", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
        "ids",
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("toxicity", not_toxic),
    ("near_duplicates", one_of_each),
    ("mixing", mixed),
    ("sentencepiece", encoded),
]

#: Trained models and iterations are beyond SQL. Tests do each stage over with the operators' own functions, and redo the
#: near-copy classes and the encoding by other code; quality and toxicity models are not trained anew by brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
