"""Matched-pair evaluation as Spark jobs: every operator takes and returns DataFrames."""
