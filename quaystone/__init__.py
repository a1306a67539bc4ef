"""Table movement, backup, reconciliation and corpus preparation on Spark DataFrames."""
