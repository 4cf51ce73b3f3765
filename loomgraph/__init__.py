"""Spark-first analytics for graphs, sparse and dense algebra, irregular access and run telemetry."""
