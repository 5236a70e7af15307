"""Reference norms over a feature corpus: manifest, resume, aggregation."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ocuspark.functions.columns import is_finite
from ocuspark.functions.reference_norms import STATS
from ocuspark.operators import ranks

# Feature names in vector order and the norm categories.
VISUAL = [
    "shannon_entropy",
    "edge_density",
    "feature_congestion",
    "subband_entropy",
    "layout_symmetry",
    "chromatic_coherence",
    "visual_hierarchy",
    "interactive_element_density",
]
SALIENCY = [
    "saliency_dispersion",
    "saliency_peak_count",
    "saliency_center_bias",
    "saliency_entropy",
    "saliency_coverage",
]
FEATURES = VISUAL + SALIENCY
CATEGORIES = ["web", "mobile", "desktop"]
QUANTILES = [0.05, 0.25, 0.5, 0.75, 0.95]


def clean_manifest(df: DataFrame, name: str = "Image Name", category: str = "Category") -> DataFrame:
    """Trim names, trim and lower categories, drop rows without a name."""
    return df.select(
        F.trim(F.col(f"`{name}`")).alias("name"), F.lower(F.trim(F.col(f"`{category}`"))).alias("category")
    ).filter(F.col("name") != "")


def allowed(df: DataFrame, categories=None) -> DataFrame:
    """Keep the norm categories (posters are not GUIs) or an explicit subset."""
    return df.filter(F.col("category").isin(list(categories or CATEGORIES)))


def balanced_sample(df: DataFrame, limit: int) -> DataFrame:
    """The first max(1, limit / categories) names of every category.

    The row_number filter is a per-group limit, which Spark also applies before
    the shuffle, so a dominant category sends only its first names.
    """
    n_categories = df.select("category").distinct().count()
    share = max(1, limit // max(n_categories, 1))
    w = Window.partitionBy("category").orderBy("name")
    return df.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= share).drop("_k")


def complete_rows(done: DataFrame, features=FEATURES) -> DataFrame:
    """Rows of an earlier run in which every feature is present."""
    return done.dropna(subset=list(features))


def still_to_do(manifest: DataFrame, done: DataFrame, key: str = "name") -> DataFrame:
    return manifest.join(done.select(key), key, "left_anti")


def progress(manifest: DataFrame, done: DataFrame, key: str = "name") -> DataFrame:
    """Per category: done, total and percent."""
    marked = manifest.join(done.select(key).distinct().withColumn("_d", F.lit(1)), key, "left")
    return marked.groupBy("category").agg(
        F.count("_d").alias("done"),
        F.count(F.lit(1)).alias("total"),
        (100.0 * F.count("_d") / F.count(F.lit(1))).alias("percent"),
    )


def to_long(df: DataFrame, id_cols, features=FEATURES) -> DataFrame:
    return df.unpivot(list(id_cols), [F.col(f).cast("double") for f in features], "feature", "value")


def feature_norms(df: DataFrame, features=FEATURES) -> DataFrame:
    """Per feature: n, mean, std (ddof 1, 0 for one value), min, max, p5 … p95."""
    long = to_long(df, [], features).filter(is_finite("value"))
    stats = long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    return stats.join(ranks.exact_quantiles(long, ["feature"], "value", QUANTILES), "feature")


def approximate_norms(df: DataFrame, features=FEATURES, accuracy: int = 10_000) -> DataFrame:
    """One-pass variant with approximate quantiles (rank error 1 / accuracy)."""
    long = to_long(df, [], features).filter(is_finite("value"))
    q = F.percentile_approx("value", QUANTILES, accuracy)
    return long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        *[q[i].alias(ranks.quantile_name(p)) for i, p in enumerate(QUANTILES)],
    )


def corpus_metadata(df: DataFrame) -> DataFrame:
    """One row: image count, category counts (map) and the categories used."""
    per = df.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(
        F.sum("n").alias("num_images"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias(
            "category_counts"
        ),
        F.array_sort(F.collect_list("category")).alias("categories_included"),
    )


def norms_dict(norms: DataFrame) -> dict[str, dict[str, float]]:
    """The norm table (one row per feature name) as literals for expressions."""
    return {r["feature"]: {s: r[s] for s in STATS} for r in norms.collect()}


def norms_table(spark: SparkSession, norms: dict[str, dict[str, float]]) -> DataFrame:
    rows = [(f, int(v["n"]), *[float(v[s]) for s in STATS[1:]]) for f, v in norms.items()]
    kinds = ", ".join(f"{s} double" for s in STATS[1:])
    return spark.createDataFrame(rows, f"feature string, n bigint, {kinds}")


def write_norms(norms: DataFrame, metadata: DataFrame, path: str) -> None:
    """Norms and corpus metadata as JSON lines next to each other."""
    norms.coalesce(1).write.mode("overwrite").json(f"{path}/features")
    metadata.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode(
        "overwrite"
    ).text(f"{path}/meta")


def read_norms(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    kinds = ", ".join(f"{s} double" for s in STATS[1:])
    features = spark.read.schema(f"feature string, n bigint, {kinds}").json(f"{path}/features")
    meta = spark.read.text(f"{path}/meta").first()
    return features, json.loads(meta[0]) if meta else {}
