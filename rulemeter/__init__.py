"""rulemeter: asks, on Spark, whether scored records could be answered by shallow rules."""
