"""Palimpsest: bitemporal, event-sourced analytics on Spark DataFrames."""
