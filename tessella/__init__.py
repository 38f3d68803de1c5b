"""Panel analytics on Spark: an expression language over firm-year tables and what is built on it."""
