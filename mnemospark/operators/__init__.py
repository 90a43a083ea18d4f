"""Operators: joins, rankings, aggregations and multi-stage jobs over DataFrames."""
