"""A pattern bank on Spark: ingest, chunk, score, search and maintain reusable code patterns as DataFrames."""
