"""Fleet telemetry analytics on PySpark.

Every operator takes DataFrames and returns DataFrames, so Catalyst sees one
plan from the scan to the sink.  See README.md for the map of the package.
"""
