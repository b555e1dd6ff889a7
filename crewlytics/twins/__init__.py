"""SQL statements that say, independently of Spark, what every query must return."""
