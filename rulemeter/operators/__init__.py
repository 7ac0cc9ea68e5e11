"""rulemeter.operators."""
