"""The report catalogue: one module per report family."""
