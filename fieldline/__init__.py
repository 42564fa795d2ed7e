"""Event analytics on Spark: shares, positions, grids, features and roles."""
