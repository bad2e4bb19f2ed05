"""Operators on light curves: DataFrame in, DataFrame out."""
