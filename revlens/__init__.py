"""Change-review analytics on Spark: cases, claims, verdicts and labels as DataFrames."""
