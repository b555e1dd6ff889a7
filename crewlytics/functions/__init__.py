"""Column helpers shared by the reports; every one is a built-in Spark expression."""
