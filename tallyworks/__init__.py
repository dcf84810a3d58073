"""Budget and procurement analytics on PySpark DataFrames."""
