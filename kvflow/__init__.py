"""kvflow: a key/value analytics engine on PySpark DataFrames."""
