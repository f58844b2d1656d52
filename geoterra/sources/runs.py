"""What a run leaves behind: its named frames, the initial solution, and a record of its failure."""

from __future__ import annotations

import json
import traceback
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.records import config_hash
from .tables import append_run, checked_name

STATUS = "run_id string, status string, config_hash string, detail string"


def persist(frames: dict[str, DataFrame], folder: str, run_id: str) -> list[str]:
    """Append each named frame to its table of runs; the names of those that had rows."""
    written = []
    for name, df in frames.items():
        if not df.isEmpty():
            append_run(df, f"{folder}/{checked_name(name)}", run_id)
            written.append(name)
    return written


def checkpointed_solution(solution: DataFrame, folder: str, run_id: str) -> DataFrame:
    """The initial solution written under the run's id and read again, so that a later failure leaves it behind."""
    path = f"{folder}/initial_solution/run_id={run_id}"
    solution.write.mode("overwrite").parquet(path)
    return solution.sparkSession.read.schema(solution.schema).parquet(path)


def recorded(spark: SparkSession, folder: str, run_id: str, config: dict, run: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """Run, keep the frames and the status; a failure leaves a row with its traceback, and is raised again."""

    def note(status: str, detail: dict) -> None:
        spark.createDataFrame([(run_id, status, config_hash(config), json.dumps(detail, ensure_ascii=False))], STATUS).coalesce(1).write.mode("append").parquet(f"{folder}/runs")

    try:
        frames = run()
        note("CONCLUIDO", {"frames": persist(frames, folder, run_id)})
        return frames
    except Exception as e:
        note("ERRO", {"type": type(e).__name__, "message": str(e), "traceback": traceback.format_exc()})
        raise


def statuses(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(STATUS).parquet(f"{folder}/runs").withColumn("detail_type", F.get_json_object("detail", "$.type"))
