"""Model stores, manifests, files and report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitweft.operators import ppm

#: Report rows (the columns of all the reports of the toolkit and the compression experiment, typed).
REPORT = "dataset string, model string, phase string, seconds double, gpu_avg double, gpu_peak double, gpu_mem_mb double, cpu_avg double, cpu_peak double, mem_mb double, original_size long, compressed_size long, cr double, ranks_0_15_pct double, ranks_0_pct double"


def write_model(counts: DataFrame, path: str, form: str = "static", title: str = "", order: int = 2) -> None:
    """A static model keeps counts only; a dynamic one keeps what training needs to go on. Partitioned by model and
    order, so that reading one model or one order prunes the rest."""
    if form not in ("static", "dynamic"):
        raise ValueError("form is static or dynamic")
    c = counts.where(F.col("k") <= order) if form == "static" else counts
    c.withColumn("form", F.lit(form)).withColumn("title", F.lit(title)).write.mode("overwrite").partitionBy("model", "k").parquet(path)


def read_model(spark: SparkSession, path: str, title: str | None = None) -> DataFrame:
    c = spark.read.parquet(path)
    return c.withColumn("title", F.lit(title)) if title is not None else c


def thaw(model: DataFrame) -> DataFrame:
    """A dynamic model as it is; a static one cannot learn again."""
    if model.where("form = 'static'").limit(1).count():
        raise ValueError("a static model cannot be trained further")
    return model


def continue_training(model: DataFrame, old_text: DataFrame, new_text: DataFrame, order: int, escape: str = "D") -> DataFrame:
    """Goes on training a dynamic model: its texts and the new ones together give the same counts as one run."""
    thaw(model)
    return ppm.train(old_text.unionByName(new_text), order, escape=escape)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """tag, path of a manifest file: two fields a line, separated by white space."""
    line = F.split(F.trim("value"), r"\s+", 2)
    return spark.read.text(path).where(F.trim("value") != "").select(line[0].alias("tag"), line[1].alias("path"))


def files(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """path, length, content of all files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "length", "content")


def symbols(spark: SparkSession, path: str, width: int = 4, little: bool = True) -> DataFrame:
    """path, symbols: the whole numbers of `width` bytes (1 to 7) that each file consists of; a file of another length is an
    error; Spark's file source passes over empty files, so they give no row."""
    if not 1 <= width <= 7:
        raise ValueError("a symbol has 1 to 7 bytes")
    places = list(range(width, 0, -1) if little else range(1, width + 1))
    one = lambda i: F.conv(F.concat(*[F.hex(F.substring("content", i * width + k, F.lit(1))) for k in places]), 16, 10).cast("long")
    whole = F.assert_true(F.col("length") % width == 0, F.concat(F.lit("not whole symbols: "), "path"))
    n = (F.col("length") / width).cast("int")
    found = F.transform(F.sequence(F.lit(0), n - 1), one)
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(whole.isNull()).select("path", found.alias("symbols"))


def write_ranks(ranks: DataFrame, path: str) -> None:
    """Ranks, one a line, in the order of (doc, pos)."""
    ranks.orderBy("doc", "pos").select(F.col("rank").cast("string").alias("value")).write.mode("overwrite").text(path)


def append_report(spark: SparkSession, rows: list[dict], path: str) -> None:
    """Appends typed report rows; missing figures are null."""
    names = [c.split()[0] for c in REPORT.split(", ")]
    spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], REPORT).write.mode("append").parquet(path)


def monitored(f, *args) -> tuple[dict, object]:
    """Report figures of a call: seconds, CPU share and change of memory of this process."""
    import os
    import resource
    import time

    t, c, m = time.time(), sum(os.times()[:2]), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    out = f(*args)
    seconds = max(time.time() - t, 1e-9)
    return {"seconds": seconds, "cpu_avg": 100 * (sum(os.times()[:2]) - c) / seconds / (os.cpu_count() or 1), "mem_mb": (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - m) / 1024}, out
