"""Incremental scans: files as they arrive, through the same narrow rules as a batch.

The scan is stateless: a file's findings depend on that file alone, so there is no watermark and any output mode but
complete works. Findings of a file that arrives twice come twice; a sink that keys on (repo, path, line_no, rule_type) is
therefore idempotent. Counts by window keep state for late data up to the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions.text import line_array
from auditloom.operators.scan import hits, scannable
from auditloom.plans.rules import Rule


def incoming(spark: SparkSession, folder: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of `folder` as they appear."""
    reader = spark.readStream.schema(schema)
    return (reader if files_per_trigger is None else reader.option("maxFilesPerTrigger", files_per_trigger)).parquet(folder)


def findings(files: DataFrame, catalogue: list[Rule]) -> DataFrame:
    """(repo, path, line_no, rule_type, severity) of a stream of files; further columns named in `files` are not kept."""
    rows = scannable(files).select("repo", "path", F.posexplode(F.transform(line_array(F.col("content")), lambda l: hits(l, catalogue))).alias("at", "hits")).where(F.size("hits") > 0)
    of = lambda get: F.element_at(F.create_map(*(F.lit(x) for r in catalogue for x in (r.place, get(r)))), F.col("rule"))
    each = rows.select("repo", "path", (F.col("at") + 1).alias("line_no"), F.explode("hits").alias("rule"))
    return each.select("repo", "path", "line_no", of(lambda r: r.kind).alias("rule_type"), of(lambda r: r.severity).alias("severity"))


def counts(events: DataFrame, time: str, window: str, late: str, *keys: str) -> DataFrame:
    """Events counted by window and keys, with late ones up to the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.count("*").alias("events"))
