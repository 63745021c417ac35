"""Operators on surveys: DataFrame in, DataFrame out."""
