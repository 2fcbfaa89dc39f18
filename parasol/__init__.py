"""Parasol: parametric-insurance analytics on Spark DataFrames."""
