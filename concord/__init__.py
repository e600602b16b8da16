"""Concord: entity resolution on Spark DataFrames."""
