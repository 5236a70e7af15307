"""Gaze, layout and interface-complexity analytics as Spark jobs."""
