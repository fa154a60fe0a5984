"""Paired-genotype analytics on Spark DataFrames."""
