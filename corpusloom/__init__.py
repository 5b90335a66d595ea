"""Corpus preparation, text features, group splits and detector evaluation on Spark DataFrames."""

__version__ = "0.1.0"
