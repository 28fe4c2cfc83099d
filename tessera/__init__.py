"""Spark-first evidence-table analytics: every operator is ``f(DataFrame, ...) -> DataFrame``."""
