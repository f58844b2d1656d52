"""A corpus pipeline of five stages: language, near copies, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``, whatever
they are besides doc_id and text. Stages decide row by row: where doc_ids repeat or are null, rows are numbered in the
order of their doc_ids, and the numbers stand in for them. Empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoterra.llm.decontamination import decontaminate
from geoterra.llm.jaccard_join import jaccard_components
from geoterra.llm.language_crf import UNKNOWN, fit, identify
from geoterra.llm.packing import pack
from geoterra.llm.store import scratch, written
from geoterra.llm.suffix_dedup import remove_repeats

#: A text whose words have a lower mean probability, each of its own best language, than this is no text in any learned language.
LEAST_LANGUAGE = 0.4


KEY = "__row_key"


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``KEY``: the doc_id, where all are different and not null; else a number in their order."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    if ids.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty():
        return docs.withColumn(KEY, F.col("doc_id").cast("long"))
    rows = written(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered-rows")
    order = rows.select(F.col("doc_id").cast("long").alias("id"), "__row").repartitionByRange("id", "__row").sortWithinPartitions("id", "__row")
    keys = written(order.select("__row", F.monotonically_increasing_id().alias(KEY)), "row-keys")
    return written(rows.join(keys, "__row").drop("__row"), "keyed-rows")


def _asked(keyed: DataFrame, *more: str) -> DataFrame:
    return keyed.select(F.col(KEY).alias("doc_id"), "text", *more)


def _without(keyed: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """The rows whose key is not among these doc_ids, which are written first, so that their size is known to the planner."""
    gone = written(ids.select(F.col("doc_id").alias(KEY)), name)
    return keyed.join(gone, KEY, "left_anti").drop(KEY)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose words have no clear language, go."""
    keyed = _keyed(docs)
    found = identify(_asked(keyed), fit(docs))
    return _without(keyed, found.filter((F.col("lang_pred") == UNKNOWN) | (F.col("best") < LEAST_LANGUAGE)), "no-language").select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of linked documents stays."""
    keyed = _keyed(docs)
    return _without(keyed, jaccard_components(_asked(keyed)).filter("component_id <> doc_id"), "near-copies").select(docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go, and documents that are nothing else. A character cut in two by a removed byte goes too. ``n_chars``, where there is one, counts what is left."""
    keyed = _keyed(docs)
    rest = [c for c in docs.columns if c != "text"]
    out = remove_repeats(_asked(keyed, F.struct(*rest).alias("rest")), keep=("rest",), as_text=True)
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept")).otherwise(F.when(F.col("was_null"), F.lit(None)).otherwise(F.col("kept")))
    columns = {c: F.col(f"rest.`{c}`") for c in rest} | {"text": text}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(changed, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return out.filter(~changed | (F.trim("kept") != "")).select(*[columns[c].alias(c) for c in docs.columns])


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    keyed = _keyed(docs)
    found = decontaminate(_asked(keyed), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(keyed, found.filter(F.size("hit_words") > 0), "contaminated").select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("language", language), ("near_copies", near_copies), ("passages", passages), ("benchmark", benchmark), ("packing", packing)]
#: The language and suffix-array stages have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
