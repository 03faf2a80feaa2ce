"""Pool-based active learning and data selection on Spark DataFrames."""
