"""Analytics over versioned entity graphs, as Spark DataFrames."""
