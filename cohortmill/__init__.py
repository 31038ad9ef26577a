"""Phenotype cohort analytics on Spark DataFrames."""
