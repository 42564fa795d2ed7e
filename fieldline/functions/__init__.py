"""Column functions: expressions over one row, all built-in Spark SQL."""
