"""tallymill: token-usage analytics expressed as Spark DataFrames, SQL and Structured Streaming."""
