"""Revision analytics on Spark: the editing history of many documents as DataFrames."""
