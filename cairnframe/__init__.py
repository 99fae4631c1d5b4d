"""Content-addressed data operators on PySpark DataFrames."""
