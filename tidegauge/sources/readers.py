"""Readers for sample, prediction, loss, feature and report files. Schemas are explicit; empty text becomes NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.core.expr import doubles
from tidegauge.functions import answers as fn

SAMPLE = (
    "uid string, task_id int, question string, options map<string,string>, type_id int, type string, ground_truth string, "
    "image_path string, pre_image_path string, post_image_path string, prompts array<string>"
)


def read_samples(spark: SparkSession, glob: str, lines: bool = False) -> DataFrame:
    """Samples from JSON files, arrays or one per line; rows without any image path are dropped, the file is kept as source."""
    raw = spark.read.schema(SAMPLE).option("multiLine", not lines).json(glob)
    return typed_samples(raw.withColumn("source_file", F.input_file_name()))


def typed_samples(raw: DataFrame) -> DataFrame:
    images = fn.image_refs(*[F.nullif(F.trim(c), F.lit("")) for c in ("pre_image_path", "post_image_path", "image_path")])
    question = F.coalesce(F.nullif("question", F.lit("")), F.get("prompts", F.lit(0)))
    return raw.withColumn("image_paths", images).withColumn("question", question).where(F.size("image_paths") > 0)


def parse_lines(lines: DataFrame, value: str, schema: str, line: str) -> tuple[DataFrame, DataFrame]:
    """Good rows and bad lines of JSON lines; blank lines and # comments are skipped."""
    text = F.trim(F.regexp_replace(value, "^\\uFEFF", ""))
    kept = lines.withColumn("_t", text).where((F.col("_t") != "") & ~F.col("_t").startswith("#"))
    parsed = kept.withColumn("_r", F.from_json("_t", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    good = parsed.where(F.col("_r._bad").isNull()).select(line, "_r.*").drop("_bad")
    bad = parsed.where(F.col("_r._bad").isNotNull()).select(line, F.col("_t").alias("text"))
    return good, bad


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, line): text lines with their 1-based number in the file.

    Lines are numbered inside their split of the file and shifted by the lines of the splits before it, so a large file is
    numbered by as many tasks as it has splits.
    """
    raw = spark.read.option("recursiveFileLookup", True).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_from"), F.monotonically_increasing_id().alias("_at")
    )
    inside = F.row_number().over(Window.partitionBy("file", "_from").orderBy("_at"))
    counts = raw.groupBy("file", "_from").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file").orderBy("_from").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("file", "_from", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    return raw.withColumn("_i", inside).join(shifts, ["file", "_from"]).select("value", "file", (F.col("_shift") + F.col("_i")).alias("line"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """JSON-lines files as (rows, bad lines): all of both, with file and line number. A report may show the first few."""
    lines = numbered_lines(spark, path).withColumn("at", F.struct("file", "line"))
    good, bad = parse_lines(lines, "value", schema, "at")
    return tuple(df.select("at.file", "at.line", *[c for c in df.columns if c != "at"]) for df in (good, bad))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Headed CSV (a leading BOM is accepted)."""
    return spark.read.schema(schema).option("header", True).option("encoding", "UTF-8").csv(path)


def union_wide(*frames: DataFrame) -> DataFrame:
    """Rows of all frames under the union of their columns."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def read_features(spark: SparkSession, path: str, vector: str = "embedding") -> DataFrame:
    """Stored float vectors as double arrays, with the dimension."""
    df = spark.read.parquet(path)
    return df.withColumn(vector, doubles(vector)).withColumn("dim", F.size(vector))


def path_parts(path: Column, pattern: str, names: list[str]) -> list[Column]:
    """Named capture positions of a path, NULL where the path does not match."""
    return [F.nullif(F.regexp_extract(path, pattern, i), F.lit("")).alias(n) for i, n in enumerate(names, 1)]


def read_reports(spark: SparkSession, glob: str, schema: str, pattern: str, names: list[str], lines: bool = False) -> DataFrame:
    """Report files at any depth, indexed by keys parsed out of their path."""
    raw = spark.read.schema(schema).option("multiLine", not lines).option("recursiveFileLookup", True).json(glob)
    return raw.withColumn("path", F.input_file_name()).select("*", *path_parts(F.col("path"), pattern, names))


def category_rows(raw: DataFrame, options: str, answers: list[str], task: str, qid: str, ord_: str) -> DataFrame:
    """Typed question rows: options parsed, answer resolved to a letter; rows that cannot be read are skipped."""
    o = raw.withColumn("_o", fn.parse_options(F.col(options)))
    key = fn.answer_key(F.col("_o"), [F.col(a) for a in answers])
    kept = o.withColumn("answer", key).where(F.col("_o").isNotNull() & F.col("answer").isNotNull())
    uid = F.concat_ws("_", task, F.coalesce(F.col(qid).cast("string"), F.col(ord_).cast("string")), ord_)
    return kept.select(uid.alias("uid"), F.col(task).alias("task_key"), F.col("_o").alias("options"), "answer",
                       fn.clean_label(F.element_at("_o", F.col("answer"))).alias("label"))
