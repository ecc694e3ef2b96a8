"""Sources and sinks: file scans, JSON documents under explicit schemas, ledgers."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What a corpus scan leaves out unless derived files are asked for.
EXCLUDED_FOLDERS = ("中文译版", "翻译工作记录", "临时工作区", "tmp", ".git", ".venv", "venv")
DERIVED_SUFFIXES = ("_translated", "_candidate", "_review")


def included(path, root: str, include_derived: bool = False):
    """Column predicate: no excluded folder below the root, no derived name."""
    below = F.regexp_replace(path, "^.*?" + root.strip("/").replace(".", r"\."), "")
    ok = ~below.rlike("/(?:" + "|".join(x.replace(".", r"\.") for x in EXCLUDED_FOLDERS) + ")/")
    if not include_derived:
        ok = ok & ~path.rlike("(?i)(?:" + "|".join(DERIVED_SUFFIXES) + r")\.[a-z]+$")
    return ok


def scan_files(spark: SparkSession, root: str, glob: str = "*.pdf", include_derived: bool = False) -> DataFrame:
    """path, sha256, bytes of every file below root; order is the caller's (by path for reports)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    files = files.where(included(F.col("path"), root, include_derived))
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON documents of a declared schema; a malformed one fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)


def write_json(df: DataFrame, path: str) -> None:
    """Replaces the target; Spark's committer publishes whole files only."""
    df.write.mode("overwrite").json(path)


def job_path(job_dir: str, value: str) -> str:
    """A path inside the job folder; absolute and escaping ones are refused."""
    whole = posixpath.normpath(posixpath.join(job_dir, value))
    if posixpath.isabs(value) or not whole.startswith(posixpath.normpath(job_dir) + "/"):
        raise ValueError(f"not inside the job folder: {value}")
    return whole


def scan_ledgers(spark: SparkSession, root: str, schema: T.StructType | str) -> DataFrame:
    """All run-metrics.json below root, without history folders."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "run-metrics.json").option("multiLine", True).json(root)
    return rows.where(~F.col("_metadata.file_path").contains("/history/"))


def append_events(ledger: DataFrame, new: DataFrame, by: str = "job_id", order: str = "recorded_at") -> DataFrame:
    """New events with ids that continue each job's; rows with a negative number are an error."""
    numbers = [f.name for f in new.schema if isinstance(f.dataType, (T.NumericType,))]
    bad = F.lit(False)
    for name in numbers:
        bad = bad | (F.coalesce(F.col(name), F.lit(0)) < 0)
    checked = new.withColumn("_bad", F.when(bad, F.raise_error(F.lit("negative metric"))))
    last = ledger.groupBy(by).agg(F.max("event_id").alias("_last"))
    out = checked.join(last, by, "left")
    n = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return out.withColumn("event_id", (F.coalesce("_last", F.lit(0)) + n).cast("int")).where("_bad is null").drop("_last", "_bad")


def known_jobs(sources: DataFrame, jobs: DataFrame) -> DataFrame:
    """Sources whose content some job already has."""
    return sources.join(jobs.select("sha256").distinct(), "sha256", "left_semi")


def scan_receipt(pages: DataFrame) -> DataFrame:
    """Counts of what each page's scan holds."""
    arrays = [f.name for f in pages.schema if isinstance(f.dataType, T.ArrayType)]
    keys = [c for c in ("doc_id", "page") if c in pages.columns]
    return pages.select(*keys, *[F.greatest(F.size(c), F.lit(0)).alias(f"{c}_count") for c in arrays])
