"""Commerce analytics and corpus processing on PySpark DataFrames."""
