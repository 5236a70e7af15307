"""File sources and sinks with fixed schemas."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# File formats and condition folders.
IMAGE_EXTENSIONS = ["png", "jpg", "jpeg", "bmp", "tiff", "webp"]
CONDITIONS = ["abs", "low", "high", "all"]

GAZE_SCHEMA = (
    "recording_id BIGINT, sample_id BIGINT, device_us BIGINT, left_x DOUBLE, left_y DOUBLE,"
    " right_x DOUBLE, right_y DOUBLE, left_valid INT, right_valid INT"
)
TRIAL_SCHEMA = (
    "participant BIGINT, image_name STRING, cognitive_load STRING, highlight STRING,"
    " total_num_fixations DOUBLE, mean_fixation_duration DOUBLE, fixation_frequency DOUBLE,"
    " total_fixation_duration DOUBLE, aoi_hit INT"
)


def read_gaze(spark: SparkSession, path: str) -> DataFrame:
    """Gaze CSV with header; the text NaN is a missing coordinate."""
    return (
        spark.read.schema(GAZE_SCHEMA)
        .options(header=True, mode="PERMISSIVE", nullValue="NaN")
        .csv(path)
    )


def stream_gaze(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return (
        spark.readStream.schema(GAZE_SCHEMA)
        .options(header=True, nullValue="NaN", maxFilesPerTrigger=files_per_trigger)
        .csv(path)
    )


def write_gaze(df: DataFrame, path: str) -> None:
    """Gaze CSV with missing values spelled NaN."""
    df.write.mode("overwrite").options(header=True, nullValue="NaN").csv(path)


def read_log(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """Comma-separated log lines as string columns c0 … (trimmed lines)."""
    return split_lines(spark.read.text(path), columns)


def split_lines(lines: DataFrame, columns: int) -> DataFrame:
    parts = F.split(F.trim(F.col("value")), ",")
    return lines.select(*[F.get(parts, F.lit(i)).alias(f"c{i}") for i in range(columns)])


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRIAL_SCHEMA).options(header=True, mode="PERMISSIVE").csv(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Semicolon-separated manifest of image names and categories."""
    from ocuspark.operators.norms import clean_manifest

    raw = (
        spark.read.schema("`Image Name` STRING, Category STRING")
        .options(header=True, sep=";")
        .csv(path)
    )
    return clean_manifest(raw)


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded screenshots; unreadable files are dropped."""
    return (
        spark.read.format("image")
        .option("dropInvalid", True)
        .option("pathGlobFilter", "*.{" + ",".join(IMAGE_EXTENSIONS) + "}")
        .load(folder)
        .select(
            F.col("image.origin").alias("image_id"),
            F.col("image.width").alias("width"),
            F.col("image.height").alias("height"),
            F.col("image.nChannels").alias("channels"),
            F.col("image.data").alias("data"),
        )
    )


def image_pixels(images: DataFrame, step: int = 1) -> DataFrame:
    """Pixel table (image_id, y, x, b, g, r) of decoded images.

    ``step`` > 1 takes every step-th row and column. Images are cut into rows
    first, so one large image is spread when the rows are repartitioned.
    """
    line = F.col("width") * F.col("channels")
    rows = images.withColumn(
        "y", F.explode(F.sequence(F.lit(0), F.col("height") - 1, F.lit(step)))
    ).select(
        "image_id",
        "y",
        "width",
        "channels",
        F.substring(F.col("data"), F.col("y") * line + 1, line).alias("line"),
    )
    cells = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width") - 1, F.lit(step))))

    def byte(k: int):
        # Grey images have one channel, used for all three colours.
        offset = F.col("x") * F.col("channels") + F.least(F.lit(k), F.col("channels") - 1) + 1
        return F.conv(F.hex(F.substring(F.col("line"), offset, F.lit(1))), 16, 10).cast("int")

    return cells.select("image_id", "y", "x", *[byte(k).alias(c) for k, c in enumerate("bgr")])


def file_identity(spark: SparkSession, folder: str) -> DataFrame:
    """Path, size and content hash of every file."""
    files = spark.read.format("binaryFile").load(folder)
    return files.select("path", "length", content_hash("content").alias("sha256"))


def content_hash(column: str):
    return F.sha2(F.col(column).cast("binary"), 256)


def stem(path: str = "path"):
    return F.regexp_extract(F.col(path), r"([^/]*?)(?:\.[^./]*)?$", 1)


def pair_by_stem(images: DataFrame, truth: DataFrame) -> DataFrame:
    """Images with the truth map of the same stem (first extension by name)."""
    first = lambda df, name: df.groupBy(stem().alias("stem")).agg(F.min("path").alias(name))
    return first(images, "image_path").join(first(truth, "truth_path"), "stem")


def condition_manifest(images: DataFrame, labels: DataFrame, fixations: DataFrame) -> DataFrame:
    """Image x condition rows for which label and fixation map both exist.

    Paths look like ``labels_high/name.png`` and ``fixs_high/name.png``.
    """

    def keyed(df: DataFrame, kind: str, name: str) -> DataFrame:
        condition = F.regexp_extract("path", rf"{kind}_([a-z]+)/", 1)
        return df.select(
            stem().alias("image_id"), condition.alias("condition"), F.col("path").alias(name)
        ).filter(F.col("condition").isin(*CONDITIONS))

    pairs = keyed(labels, "labels", "label_path").join(
        keyed(fixations, "fixs", "fixation_path"), ["image_id", "condition"]
    )
    return pairs.join(images.select("image_id").distinct(), "image_id")


def highlight_filter(ids: DataFrame, mode: str = "both") -> DataFrame:
    marked = F.contains(F.col("image_id"), F.lit("_highlight"))
    if mode == "none":
        return ids.filter(~marked)
    if mode == "highlight":
        return ids.filter(marked)
    return ids


def highlight_pairs(ids: DataFrame) -> DataFrame:
    """base, base_1, base_2 for every base that has both images.

    Both ids of a base meet in one grouping instead of a self-join.
    """
    base = F.regexp_extract("image_id", r"^(.*)_[^_]*$", 1)
    part = F.regexp_extract("image_id", r"_([^_]*)$", 1)
    pick = lambda k: F.max(F.when(F.col("part") == k, F.col("image_id")))
    return (
        ids.select("image_id", base.alias("base"), part.alias("part"))
        .filter(F.col("part").isin("1", "2"))
        .groupBy("base")
        .agg(pick("1").alias("first_id"), pick("2").alias("second_id"))
        .filter(F.col("first_id").isNotNull() & F.col("second_id").isNotNull())
    )


def write_features(df: DataFrame, path: str) -> None:
    """Append per-image features, one folder per category."""
    df.write.mode("append").partitionBy("category").parquet(path)


def read_features(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of all committed batches with their ``batch``; ``schema`` is that of the features written."""
    known = StructType([*schema.fields, StructField("batch", StringType())])
    try:
        return spark.read.schema(known).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], known)


def append_features(df: DataFrame, path: str, batch: str, key: str) -> None:
    """Add a batch of features exactly once, one folder per batch and category.

    A batch that is run again, whole or after a failure, replaces its own folder,
    and rows whose key another batch holds already are left out, so neither a
    rerun nor an overlapping batch stores a row twice. Task outputs stay hidden
    until the batch is committed. Rows without a key are stored as they come;
    an empty batch stores nothing. One writer at a time per path.
    """
    stored = read_features(df.sparkSession, path, df.schema).filter(F.col("batch") != batch).select(key)
    fresh = df.join(stored, key, "left_anti").select(*df.columns)
    fresh.write.mode("overwrite").partitionBy("category").parquet(f"{path}/batch={batch}")


def write_lookup(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """Result tables (comparison, ablation, importance, metrics) as CSV with header."""
    df.write.mode("overwrite").option("header", True).csv(path)
