"""rulemeter.streaming."""
