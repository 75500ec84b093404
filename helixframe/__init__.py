"""Variant analytics on Spark: VCF as typed, nested DataFrames."""
