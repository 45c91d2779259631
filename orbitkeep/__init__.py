"""Analytics over replicated key/value object stores, as Spark DataFrames."""
