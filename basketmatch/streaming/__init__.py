"""Change logs: batch folds, outcomes per change and their streams."""
