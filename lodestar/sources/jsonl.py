"""Sources and sinks: JSONL corpora, personas, indexes, logs, dumps. Paths are Hadoop paths, read and written by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import written

CORPUS = "id string, contents string, metadata struct<last_modified_date: string, file_name: string, source_file: string>, embedding array<float>"
BAD = "bad_line_"


def read_jsonl(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = (), keep_bad: bool = False) -> DataFrame:
    """Rows of the .jsonl files of a folder (or a file); blank and undecodable lines and rows without required fields go.

    With keep_bad they stay, with the line in bad_line_.
    """
    rows = spark.read.schema(f"{schema}, {BAD} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).option("pathGlobFilter", "*.jsonl").json(path)
    if keep_bad:
        return rows
    rows = rows.filter(F.col(BAD).isNull()).drop(BAD)
    return rows.dropna(subset=list(required)) if required else rows


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value and line, 0-based, of one text file in order: lines are numbered by the offsets of partitions, no task takes a whole file."""
    rows = written(spark.read.text(path).withColumn("id_", F.monotonically_increasing_id()), "lines").withColumn("part_", F.shiftright("id_", 33))
    counts = rows.groupBy("part_").agg(F.count("*").alias("n_"))
    before = counts.select("part_", F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
    return rows.join(F.broadcast(before), "part_").select("value", (F.col("before_") + F.col("id_") - F.shiftleft("part_", 33)).alias("line"))


def read_personas(spark: SparkSession, path: str) -> DataFrame:
    """id (the physical line), persona, original: single-quoted objects are read as JSON; lines without a persona go."""
    lines = spark.read.text(path).withColumn("id", F.monotonically_increasing_id())
    parsed = F.coalesce(F.get_json_object(F.replace(F.col("value"), F.lit("'"), F.lit('"')), "$.persona"), F.get_json_object("value", "$.persona"), F.nullif(F.regexp_extract("value", r"""^\{\s*['"]persona['"]\s*:\s*['"](.*)['"]\s*\}$""", 1), F.lit("")))
    return lines.select("id", parsed.alias("persona"), F.col("value").alias("original")).filter(F.length(F.trim("persona")) > 0)


def last_rows(rows: DataFrame) -> DataFrame:
    """id, contents: of each id the row that is last by its place in the files."""
    return rows.withColumn("p_", F.monotonically_increasing_id()).groupBy("id").agg(F.max_by("contents", "p_").alias("contents"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """id, contents of a corpus; the last row of an id wins, by its place in the files."""
    return last_rows(read_jsonl(spark, path, CORPUS, ("id", "contents")))


def write_single(rows: DataFrame, path: str) -> None:
    """Parquet as one file, for small sets that a consumer reads as one."""
    rows.coalesce(1).write.mode("overwrite").parquet(path)


def write_example(rows: DataFrame, path: str) -> None:
    rows.limit(1).coalesce(1).write.mode("overwrite").json(path)


def append_new(rows: DataFrame, path: str, key: str) -> DataFrame:
    """Appends the rows whose key is not there yet, and returns them: a run that broke off goes on where it stopped."""
    spark = rows.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        done = spark.read.schema(rows.schema).json(path).select(key)
        rows = rows.join(done, key, "left_anti")
    rows.write.mode("append").json(path)
    return rows


def append_log(run: DataFrame, path: str) -> None:
    """A run's record, appended to a log table."""
    run.write.mode("append").json(path)


def log_array(spark: SparkSession, path: str, schema: str, order: str) -> DataFrame:
    """The log as one JSON array, in order."""
    rows = read_any_json(spark, path, schema)
    return rows.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(order, F.struct(*rows.columns).alias("r")))), lambda s: s["r"])).alias("log"))


def read_any_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def save_vectors(rows: DataFrame, path: str, cluster: str | None = None) -> None:
    """A vector index: id, embedding, by cluster where given; the metric belongs to the query."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(cluster) if cluster else writer).parquet(path)


def write_dump(rows: DataFrame, path: str) -> None:
    """JSON lines by step."""
    rows.write.mode("append").partitionBy("step").json(path)


def metric_rows(metrics: DataFrame, step: int) -> DataFrame:
    """One wide row of numbers as long rows: step, name, value."""
    names = metrics.columns
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names])
    return metrics.select(F.lit(step).alias("step"), F.inline(pairs))


def create_collection(spark: SparkSession, name: str, path: str) -> None:
    """A vector collection as a partitioned table; nothing that exists is dropped."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (id STRING, text_chunk STRING, embedding ARRAY<FLOAT>, source STRING, publish_time BIGINT, metadata STRING, part STRING) USING parquet PARTITIONED BY (part) LOCATION '{path}'")
