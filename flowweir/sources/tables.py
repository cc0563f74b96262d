"""CSV datasets, detection log, label file, reports, digests."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowweir.functions.columns import as_column
from flowweir.schema import RAW_COLUMNS
from flowweir.session import stage_table


def load_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """One CSV dataset. Only ``.csv`` is read; a missing path is FileNotFoundError.

    Without a schema every column is text; types are the caller's to set.
    """
    if not path.rstrip("/").lower().endswith(".csv"):
        raise ValueError(f"unsupported file format: {path}")
    reader = spark.read.option("header", True)
    try:
        return (reader.schema(schema) if schema else reader).csv(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(path) from error
        raise


def csv_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Column names of each CSV file of a folder: ``file`` and ``names``, trimmed."""
    lines = spark.read.text(f"{folder}/*.csv")
    # The first line of each file is in its first block.
    opening = lines.filter("_metadata.file_block_start = 0").select(
        F.col("_metadata.file_path").alias("file"),
        "value",
        F.monotonically_increasing_id().alias("at"),
    )
    header = F.regexp_replace(F.min_by("value", "at"), "^\ufeff", "")
    names = F.transform(F.split(header, ","), lambda n: F.btrim(F.btrim(n), F.lit('"')))
    return opening.groupBy("file").agg(names.alias("names"))


def load_raw_flow_directory(spark: SparkSession, path: str, columns=RAW_COLUMNS) -> DataFrame:
    """All raw flow CSVs of a folder as text, only the needed columns.

    Columns go by name, file by file, so files may have other orders and more
    columns. Header names are trimmed; the first of a repeated name counts. A file
    without one of the columns is refused. One scan reads all files by place; a table of
    places per file, which has one narrow row per file, says where each column is.
    """
    folder = path.rstrip("/")
    try:
        headers = csv_headers(spark, folder)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"no CSV files in {folder}") from error
        raise
    places = [F.array_position("names", c) for c in columns]
    lacking = F.filter(
        F.array(*[F.lit(c) for c in columns]), lambda c: ~F.array_contains(F.col("names"), c)
    )
    located = stage_table(
        headers.select(
            "file", F.array(*places).alias("places"), lacking.alias("lacking"), F.size("names").alias("width")
        ),
        "headers",
    )
    width = located.agg(F.max("width")).first()[0]
    if width is None:
        raise FileNotFoundError(f"no CSV files in {folder}")
    bad = located.filter(F.size("lacking") > 0).orderBy("file").first()
    if bad:
        raise ValueError(f"missing columns in {bad['file']}: {bad['lacking']}")
    by_place = [f"_{i}" for i in range(width)]
    table = (
        spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in by_place]))
        .option("header", True)
        # Names are bound below, not by the scan.
        .option("enforceSchema", True)
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .csv(f"{folder}/*.csv")
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_name").alias("source_file"),
            F.array(*by_place).alias("fields"),
        )
    )
    placed = table.join(located.select("file", "places"), "file")
    return placed.select(
        "source_file",
        *[
            F.get("fields", F.get("places", F.lit(i)).cast("int") - 1).alias(c)
            for i, c in enumerate(columns)
        ],
    )


def require_single_file(df: DataFrame) -> DataFrame:
    """Refuse a dataset that does not consist of exactly one file."""
    files = df.inputFiles()
    if len(files) != 1:
        raise RuntimeError(f"expected exactly one file, found {len(files)}")
    return df


def detection_log_rows(verdicts: DataFrame, timestamp="timestamp", *carry) -> DataFrame:
    """Log form of verdicts: percent confidence and duration at two places.

    ``carry`` names further columns of the log, such as its sequence number.
    """
    return verdicts.select(
        *carry,
        F.date_format(as_column(timestamp), "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.col("prediction").cast("int").alias("prediction"),
        F.round(F.col("confidence") * 100, 2).alias("confidence"),
        "severity",
        F.col("packet_count").alias("packets_captured"),
        F.round("duration", 2).alias("capture_duration"),
    )


def append_rows(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append to a log or label table; CSV parts each carry the header."""
    writer = df.write.mode("append").format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def recent_history(log: DataFrame, order: str, rows: int = 10) -> DataFrame:
    """Newest log rows with their display texts, as the log holds the numbers.

    ``order`` is the log's sequence number: times in whole seconds repeat.
    """
    newest = log.orderBy(F.desc(order)).limit(rows)
    return newest.select(
        "timestamp",
        F.when(F.col("prediction") == 1, "ATTACK").otherwise("NORMAL").alias("verdict"),
        F.concat(F.col("confidence").cast("string"), F.lit("%")).alias("confidence_text"),
        "severity",
        "packets_captured",
        F.concat(F.col("capture_duration").cast("string"), F.lit("s")).alias("duration_text"),
    )


def write_report(df: DataFrame, path: str) -> None:
    """JSON lines, nulls included; reports are small tables that Spark has already reduced."""
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def artifact_digests(spark: SparkSession, path: str) -> DataFrame:
    """Upper-case SHA-256 of every file under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", digest("content").alias("sha256"))


def digest(content):
    return F.upper(F.sha2(as_column(content), 256))
