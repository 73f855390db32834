"""Whole jobs and the report queries built from the stages."""
