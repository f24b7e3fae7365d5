"""Spark ML programs: preprocessing, candidates, selection, scoring, attribution."""
