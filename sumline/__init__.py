"""Financial-statement tables and corpus preparation on Spark."""
