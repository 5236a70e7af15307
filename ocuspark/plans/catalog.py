"""Imports every plan module so that its queries are registered."""

from ocuspark.plans import (  # noqa: F401
    gaze_plans,
    layout_plans,
    map_plans,
    ml_plans,
    scoring_plans,
    source_plans,
    stream_plans,
    study_plans,
)
from ocuspark.plans.registry import CHECKS, QUERIES  # noqa: F401
