"""barlab: quantitative-research analytics on PySpark DataFrames."""
