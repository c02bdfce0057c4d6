"""sedimenta: a medallion analytics engine on Spark DataFrames, with its own versioned table layer."""
