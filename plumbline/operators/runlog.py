"""Run logs as tables: numbered lines, extracted events, merged times, report order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Line formats of worker and finalize logs (fixed values).
TASK_SOLVE = r"\[worker \d+/\d+ class (\d+) (?:client (\S+)|(baseline))\] FHE solve: ([\d.]+)s"
TASK_RESUME = r"\[worker \d+/\d+ class (\d+) (?:client (\S+)|(baseline))\] Resuming from checkpoint"
CONTEXT_LOAD = r"\[worker (\d+)/\d+\] Context loaded in ([\d.]+)s"
PEAK_RSS = r"\[worker \d+/\d+\] PEAK RSS: ([\d.]+) MiB"
DONE = r"\[worker \d+/\d+\] DONE: (\d+) solved, (\d+) resumed, ([\d.]+)min total"
CLASS_HEADER = r"--- Class (\d+) \((\S+) vs rest\)"
FINAL_SOLVE = r"\[(?:client (\S+)|(baseline))\] FHE solve: ([\d.]+)s"
FINAL_RESUME = r"\[(?:client (\S+)|(baseline))\] Resuming from checkpoint"
METRIC_ROW = r"^\s{2,}(\S.*?)\s*\|\s*([\d.]+)%\s*\|\s*([\d.]+)%\s*\|\s*([\d.]+)%\s*$"
WEIGHT_ERROR = r"FHE fed weights vs plaintext fed weights: ([\d.eE+-]+)"


MULTICLASS = r"Multiclass Accuracy \((.+?)\):\s+([\d.]+)%"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no, line of every log; the whole file is read at once because lines need their order."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))
    return files.select("file", F.posexplode(F.split("value", "\n")).alias("line_no", "line"))


def group(pattern: str, n: int, line: str = "line") -> Column:
    return F.nullif(F.regexp_extract(F.col(line), pattern, n), F.lit(""))


def worker_tasks(lines: DataFrame) -> DataFrame:
    """file, class_idx, client, seconds (null: resumed only): solves overwrite, a resume keeps what is there."""
    solved, resumed = F.col("line").rlike(TASK_SOLVE), F.col("line").rlike(TASK_RESUME)
    pick = lambda n: F.when(solved, group(TASK_SOLVE, n)).otherwise(group(TASK_RESUME, n))
    events = lines.where(solved | resumed).select("file", "line_no", pick(1).cast("int").alias("class_idx"), F.coalesce(pick(2), pick(3)).alias("client"), F.when(solved, group(TASK_SOLVE, 4).cast("double")).alias("seconds"))
    return events.groupBy("file", "class_idx", "client").agg(F.max_by("seconds", F.when(F.col("seconds").isNotNull(), F.col("line_no"))).alias("seconds"))


def worker_totals(lines: DataFrame) -> DataFrame:
    last = lambda p, n, kind: F.max_by(group(p, n).cast(kind), F.when(F.col("line").rlike(p), F.col("line_no")))
    return lines.groupBy("file").agg(last(CONTEXT_LOAD, 2, "double").alias("context_s"), last(PEAK_RSS, 1, "double").alias("peak_rss_mib"), F.coalesce(last(DONE, 1, "int"), F.lit(0)).alias("solved"), F.coalesce(last(DONE, 2, "int"), F.lit(0)).alias("resumed"))


def finalize_rows(lines: DataFrame) -> DataFrame:
    """Lines with the class and the comparison block they stand in (state carried down within a file)."""
    down = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    header = F.when(F.col("line").rlike(CLASS_HEADER), F.struct(group(CLASS_HEADER, 1).cast("int").alias("idx"), group(CLASS_HEADER, 2).alias("name")))
    block = F.when(F.col("line").rlike(CLASS_HEADER) & F.col("line").contains("comparison"), group(CLASS_HEADER, 1).cast("int"))
    return lines.withColumn("head", F.last(header, True).over(down)).withColumn("block", F.last(block, True).over(down)).select("*", F.col("head.idx").alias("class_idx"), F.col("head.name").alias("class_name")).drop("head")


def finalize_metrics(lines: DataFrame) -> DataFrame:
    rows = finalize_rows(lines).where(F.col("block").isNotNull() & F.col("line").rlike(METRIC_ROW) & (group(METRIC_ROW, 1) != "Approach"))
    return rows.select(F.col("block").alias("class_idx"), group(METRIC_ROW, 1).alias("approach"), *[group(METRIC_ROW, i).cast("double").alias(n) for i, n in ((2, "accuracy"), (3, "precision"), (4, "f1"))])


def finalize_times(lines: DataFrame) -> DataFrame:
    solved, resumed = F.col("line").rlike(FINAL_SOLVE), F.col("line").rlike(FINAL_RESUME)
    rows = finalize_rows(lines).where((solved | resumed) & F.col("class_idx").isNotNull() & ~F.col("line").rlike(CLASS_HEADER))
    client = F.coalesce(group(FINAL_SOLVE, 1), group(FINAL_SOLVE, 2), group(FINAL_RESUME, 1), group(FINAL_RESUME, 2))
    return rows.groupBy("class_idx", client.alias("client")).agg(F.max_by(group(FINAL_SOLVE, 3).cast("double"), F.when(solved, F.col("line_no"))).alias("seconds"))


def merged_times(workers: DataFrame, finalize: DataFrame) -> DataFrame:
    """class_idx, client, seconds, worker: a later worker overrides if it has a time; a finalize time overrides
    the value but not the name of a worker that is known."""
    order = F.struct(F.col("seconds").isNotNull(), F.col("file"))
    first = F.min("file")
    w = workers.groupBy("class_idx", "client").agg(F.max_by("seconds", order).alias("ws"), F.when(F.max(F.col("seconds").isNotNull()), F.max_by("file", order)).otherwise(first).alias("wid"))
    f = finalize.select("class_idx", "client", F.col("seconds").alias("fs"))
    both = w.join(f, ["class_idx", "client"], "full")
    return both.select("class_idx", "client", F.coalesce("fs", "ws").alias("seconds"), F.coalesce("wid", F.when(F.col("fs").isNotNull(), F.lit("finalize"))).alias("worker"))


def report_order(df: DataFrame) -> DataFrame:
    """By class; baseline last; clients by number through zero padding to four places, longer names whole."""
    padded = F.when(F.length("client") < 4, F.lpad("client", 4, "0")).otherwise(F.col("client"))
    return df.orderBy("class_idx", F.col("client") == "baseline", padded)


def multiclass_accuracies(lines: DataFrame) -> DataFrame:
    """approach, accuracy_pct of the multiclass lines; the last line of an approach counts."""
    rows = lines.where(F.col("line").rlike(MULTICLASS)).select("line_no", group(MULTICLASS, 1).alias("approach"), group(MULTICLASS, 2).cast("double").alias("accuracy_pct"))
    return rows.groupBy("approach").agg(F.max_by("accuracy_pct", "line_no").alias("accuracy_pct"))


def weight_errors(lines: DataFrame) -> DataFrame:
    """class_idx, rel_err of the weight comparison lines in a finalize log."""
    rows = finalize_rows(lines).where(F.col("line").rlike(WEIGHT_ERROR))
    return rows.groupBy("class_idx").agg(F.max_by(group(WEIGHT_ERROR, 1).cast("double"), F.col("line_no")).alias("rel_err"))


def solve_totals(times: DataFrame) -> DataFrame:
    """class_idx, least, mean and greatest seconds of the clients that have a time, and the sum of all with the
    baseline's (null where it is 0)."""
    client = F.when(F.col("client") != "baseline", F.col("seconds"))
    return times.groupBy("class_idx").agg(F.min(client).alias("min_s"), F.avg(client).alias("avg_s"), F.max(client).alias("max_s"), F.nullif(F.coalesce(F.sum("seconds"), F.lit(0.0)), F.lit(0.0)).alias("total_s"))


def report_section(times: DataFrame, stamp: str) -> str:
    """A Markdown section of the times in report order; a run has some classes times clients rows."""
    rows = [f"| {r['class_idx']} | {r['client']} | {r['time']} |" for r in report_order(times).select("class_idx", "client", minutes(F.col("seconds")).alias("time")).collect()]
    return "\n".join([f"## Run {stamp}", "", "| Class | Client | Minutes |", "|-|-|-|", *rows, ""])


def append_report(times: DataFrame, path: str, stamp: str, title: str = "# Runs") -> None:
    """Adds a section to the report at ``path`` (any file system of Spark); the title only opens a new file."""
    spark = times.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    before = "".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()) if fs.exists(target) else f"{title}\n\n"
    out = fs.create(target, True)
    out.write(bytearray((before + report_section(times, stamp) + "\n").encode()))
    out.close()


def minutes(seconds: Column) -> Column:
    return F.when(seconds.isNull(), "n/a").otherwise(F.format_string("%.1f", seconds / 60))


def communication(manifest: DataFrame) -> DataFrame:
    """n_clients, total and mean bytes of weights and biases; baselines do not communicate. ``manifest``: path, length."""
    client = F.nullif(F.regexp_extract("path", r"(class_[^/]+/client_[^/]+)/(?:weights|bias)\.bin$", 1), F.lit(""))
    sizes = manifest.select(client.alias("c"), "length").where("c is not null").groupBy("c").agg(F.sum("length").alias("bytes"))
    return sizes.agg(F.count("*").alias("n_clients"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"), F.coalesce(F.avg("bytes"), F.lit(0.0)).alias("mean_bytes"), F.lit(1).alias("rounds"))
