"""Metric spaces, complexes and simplicial sets as DataFrames."""
