"""Queries for sources and sinks: tables written by a sink and read back by its source."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ocuspark.functions.columns import r6
from ocuspark.operators import ml, norms, search, study
from ocuspark.operators.lineage import cut, ensure_checkpoint_dir
from ocuspark.plans import map_plans, scoring_plans  # noqa: F401  (their twins are used here)
from ocuspark.plans.ml_plans import TRAIN_SQL
from ocuspark.plans.registry import CHECKS, query
from ocuspark.plans.study_plans import LOOKUP, LOOKUP_COLS
from ocuspark.sources import tables


def _folder(t) -> str:
    """A new folder that all executors share."""
    return f"{ensure_checkpoint_dir(t.spark)}/sink-{uuid.uuid4().hex}"


@query(
    "source_log_columns",
    """SELECT event_id, CAST(user_id AS VARCHAR(19)) AS c0, event_type AS c1, CAST(event_id AS VARCHAR(19)) AS c2,
      CAST(NULL AS VARCHAR(9)) AS c3 FROM events""",
)
def _(t):
    line = F.concat(F.lit(" "), F.concat_ws(",", "user_id", "event_type", "event_id"), F.lit(" "))
    split = tables.split_lines(t["events"].select(line.alias("value")), 4)
    return split.select(F.col("c2").cast("bigint").alias("event_id"), "c0", "c1", "c2", "c3")


@query(
    "source_content_identity",
    "SELECT page_id, sha256(html) AS sha256, count(*) OVER (PARTITION BY sha256(html)) AS copies FROM pages",
)
def _(t):
    pages = t["pages"].select("page_id", tables.content_hash("html").alias("sha256"))
    copies = pages.groupBy("sha256").agg(F.count(F.lit(1)).alias("copies"))
    from ocuspark.operators.skew import split_join

    return split_join(pages, copies, ["sha256"], counts=copies.withColumnRenamed("copies", "n")).select(
        "page_id", "sha256", "copies"
    )


def _rounded(df, digits: int = 9):
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


GAZE = ["left_x", "left_y", "right_x", "right_y"]


@query(
    "source_gaze_csv",
    "SELECT recording_id, sample_id, device_us, " + ", ".join(f"round({c}, 9) AS {c}" for c in GAZE) + ", left_valid, right_valid FROM gaze_samples",
    ("gaze_samples",),
)
def _(t):
    path = _folder(t)
    tables.write_gaze(t["gaze_samples"], path)
    return _rounded(tables.read_gaze(t.spark, path))


TRIAL_NUMBERS = ["total_num_fixations", "mean_fixation_duration", "fixation_frequency", "total_fixation_duration"]


@query(
    "source_trials_csv",
    "SELECT participant, image_name, cognitive_load, highlight, " + ", ".join(f"round({c}, 6) AS {c}" for c in TRIAL_NUMBERS) + ", aoi_hit FROM aoi_trials",
    ("aoi_trials",),
)
def _(t):
    path = _folder(t)
    tables.write_report(t["aoi_trials"], path)
    return _rounded(tables.read_trials(t.spark, path), 6)


@query(
    "source_lookup_table",
    LOOKUP + "SELECT image_name, " + ", ".join(f"round({c}, 6) AS {c}" for c in LOOKUP_COLS) + " FROM lookup",
    ("aoi_trials",),
)
def _(t):
    path = _folder(t)
    tables.write_lookup(study.sensitivity_lookup(t["aoi_trials"]), path)
    return tables.read_lookup(t.spark, path).select("image_name", *[r6(c).alias(c) for c in LOOKUP_COLS])


@query(
    "source_norms_json",
    f"SELECT q.*, (SELECT count(*) FROM embeddings WHERE label % 4 < 3) AS num_images FROM ({CHECKS['norms_exact']}) q",
)
def _(t):
    path, corpus = _folder(t), cut(norms.allowed(t["screen_features"]))
    norms.write_norms(norms.feature_norms(corpus), norms.corpus_metadata(corpus), path)
    stored, meta = norms.read_norms(t.spark, path)
    return _rounded(stored, 6).withColumn("num_images", F.lit(meta["num_images"]).cast("bigint"))


STORED = ["shannon_entropy", "edge_density", "saliency_coverage", "whitespace_ratio"]


@query(
    "source_features_append",
    "SELECT screen_id, category, " + ", ".join(f"round({c}, 9) AS {c}" for c in STORED) + """,
      CAST(screen_id % 3 AS VARCHAR(9)) AS batch FROM screen_features""",
    ("screen_features",),
)
def _(t):
    """Three batches, the second run twice, then one that holds only rows stored before."""
    path, rows = _folder(t), cut(t["screen_features"].select("screen_id", *STORED, "category"))
    for batch in (0, 1, 1, 2):
        tables.append_features(rows.filter(F.col("screen_id") % 3 == batch), path, str(batch), "screen_id")
    tables.append_features(rows.filter(F.col("screen_id") % 2 == 0), path, "again", "screen_id")
    return _rounded(tables.read_features(t.spark, path, rows.schema))


@query("source_report_csv", CHECKS["search_target_summary"])
def _(t):
    path, report = _folder(t), search.target_summary(t["search_trials"])
    tables.write_report(report, path)
    return t.spark.read.schema(report.schema).option("header", True).csv(path)


@query("source_model_reload", TRAIN_SQL + "SELECT image_name, true AS same FROM tr", ("aoi_trials",))
def _(t):
    """Per image: does the stored and reloaded ridge give the predictions of the fitted one?"""
    trials, path = t["aoi_trials"], _folder(t)
    train = cut(ml.training_table(study.sensitivity_lookup(trials), trials))
    model = ml.fit(train, "ridge")
    ml.save(model, path)
    names = {f"pred_{c}": f"fitted_{c}" for c in ml.TARGETS}
    fitted = ml.predict(model, train).select("image_name", *[F.col(a).alias(b) for a, b in names.items()])
    both = ml.predict(ml.load(path), train).join(fitted, "image_name")
    same = F.lit(True)
    for a, b in names.items():
        same = same & F.col(a).eqNullSafe(F.col(b))
    return both.select("image_name", same.alias("same"))
