"""Registered queries against their SQL twins on the smallest test scale.

A sample of every family runs by default; OCUSPARK_ALL=1 runs all of them.
"""

import os

import pytest

import __spark_entry__ as driver
from ocuspark.plans.catalog import QUERIES
from ocuspark.plans.compare import compare

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "gaze_fixation_summary",
    "gaze_motion_and_gaps",
    "study_sensitivity_lookup",
    "study_hypothesis_report",
    "norms_exact",
    "scoring_predictions",
    "layout_screen_consistency",
    "layout_whitespace",
    "map_agreement",
    "map_auc_judd",
    "pixel_layout_symmetry",
    "search_attention_priority",
    "search_glance_metrics",
    "ml_training_table",
    "stream_hit_rate_tumbling",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def test_contract(spark):
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert driver.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(QUERIES) if os.environ.get("OCUSPARK_ALL") else SAMPLE)
def test_query_equals_sql(spark, name):
    ok, detail = compare(spark, SF, name)
    assert ok, detail
