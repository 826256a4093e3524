"""Spark-native analytics for seismic event catalogues.

Every public function takes and returns lazy DataFrames built from Spark's own
functions, so one Catalyst plan covers a whole computation.  Actions happen only
where a table is written.
"""
