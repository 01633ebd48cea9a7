"""Corpus preparation operators for training data, all expressed on Spark."""
