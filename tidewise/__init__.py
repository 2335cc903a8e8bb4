"""Recommendation analytics on Spark: holdout splits, scorers, rank fusion, ranking metrics and batch top-k as DataFrame plans."""
