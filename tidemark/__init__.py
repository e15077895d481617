"""Change-log materialisation and freshness measurement on PySpark DataFrames."""
