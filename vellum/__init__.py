"""Vellum: document ETL and text analytics expressed as Spark DataFrames."""
