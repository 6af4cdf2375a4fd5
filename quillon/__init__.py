"""Semantic query layer on PySpark: models, declarative requests, lazy DataFrames."""
