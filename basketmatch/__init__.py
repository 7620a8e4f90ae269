"""Basket matching on Spark: search, coverage, favourites and change folds."""
