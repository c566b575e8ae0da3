"""Trace and fault-campaign analytics on PySpark DataFrames."""
