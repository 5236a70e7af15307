"""Queries that read or deal the large tables once, where they did it several times."""

import os
import re

import pytest

from ocuspark.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_images_with_both_reads_the_trials_once(spark):
    """one scan of lineitem and one of orders."""
    assert plan(spark, "study_images_with_both_conditions").count("FileScan parquet") == 2


def test_training_table_reads_the_trials_once(spark):
    """F19, F20, F21."""
    assert plan(spark, "ml_training_table").count("FileScan parquet") == 2


def test_edge_counts_are_dealt_once_a_screen(spark):
    """seven counts a screen, not a row per screen and level."""
    found = plan(spark, "pixel_visual_hierarchy")
    assert "Exchange hashpartitioning(screen_id" in found
    assert not re.search(r"Exchange hashpartitioning\(screen_id#\d+L?, level", found)


def test_whitespace_of_small_screens_needs_no_numbering(spark):
    """lineitem once, orders for the boxes and for the screens."""
    found = plan(spark, "layout_whitespace")
    assert found.count("FileScan parquet") <= 3 and "row_number(" not in found


def test_element_texts_read_the_elements_once(spark):
    """what follows works on the written elements and boxes."""
    assert plan(spark, "layout_element_texts").count("FileScan parquet") <= 1
