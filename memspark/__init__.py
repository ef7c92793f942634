"""A memory and corpus analytics engine on PySpark DataFrames."""
