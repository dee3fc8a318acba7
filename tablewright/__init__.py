"""Table quality on Spark: profile, repair, judge and learn from tables of any size."""
