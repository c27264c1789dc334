"""Operators on movement data: DataFrame in, DataFrame out."""
