"""Corpus pipeline: documents through five stages, each a written table for the next.

Stages work on rows, whatever their ids: a row's place in its file stands for it
where decisions are joined back.  Null and repeated ids, null and very long
texts, and empty tables go through; see the operators for what each makes of
them.  Columns beside doc_id, text and source are carried whatever their names.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.llm.binary import read_token_files, write_token_files
from pulseframe.llm.decontamination import mark_leaks
from pulseframe.llm.jaccard_join import jaccard_classes
from pulseframe.llm.mixing import mix_sources
from pulseframe.llm.quality import fit_quality, score_quality
from pulseframe.llm.queries import VOCABULARY
from pulseframe.llm.shared import shared_dir, written
from pulseframe.llm.tokens import vocabulary_file


def _plain(docs: DataFrame) -> DataFrame:
    """docs with its columns numbered, so that no name clashes with one that an operator adds."""
    return docs.toDF(*[f"__c{i}" for i in range(len(docs.columns))])


def _column(docs: DataFrame, name: str) -> str:
    return f"__c{docs.columns.index(name)}"


def _named(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns)])


def _with_rows(docs: DataFrame) -> DataFrame:
    """_plain(docs) with __row, which names each row: its id, and its place in the files, which no split of them changes.

    A table that lies in no files is written with numbers instead, since numbers made anew in a second scan could differ.
    """
    plain, id_col = _plain(docs), _column(docs, "doc_id")
    try:
        place = docs.select("*", F.xxhash64("_metadata.file_path").alias("__f"), F.col("_metadata.row_index").alias("__i"))
    except AnalysisException:
        plain = written(plain.withColumn("__i", F.monotonically_increasing_id()), "pipeline-rows").withColumn("__f", F.lit(0).cast("long"))
    else:
        plain = place.toDF(*plain.columns, "__f", "__i")
    return plain.withColumn("__row", F.struct(F.col(id_col).alias("doc_id"), "__f", "__i")).drop("__f", "__i")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rules and the trees keep."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _named(score_quality(_plain(docs), model, text=_column(docs, "text")).where("kept"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of least id of each class of the Jaccard join."""
    rows = _with_rows(docs)
    classes = jaccard_classes(rows, id_col="__row", text=_column(docs, "text"))
    first = classes.where("doc_id = class_id").select(F.col("doc_id").alias("__row"))
    return _named(rows.join(first, "__row", "left_semi"), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that leak no benchmark item."""
    marked = mark_leaks(_plain(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), text=_column(docs, "text"), flag="__leaks")
    return _named(marked.where("NOT __leaks"), docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them."""
    rows = _with_rows(docs)
    names = {k: _column(docs, c) for k, c in (("id_col", "doc_id"), ("text", "text"), ("source", "source"))}
    taken = mix_sources(rows, keep=("__row",), **names).where("taken > 0").select("__row", F.expr("taken div size").cast("int").alias("__times"))
    return _named(rows.join(taken, "__row").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))), docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, read back from the files."""
    out = shared_dir(spark, "token-files")
    write_token_files(docs, vocabulary_file(VOCABULARY), out)
    return read_token_files(spark, out)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_files", token_files),
]

#: Trees, tokens and approximate search have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
