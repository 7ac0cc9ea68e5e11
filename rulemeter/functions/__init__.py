"""rulemeter.functions."""
