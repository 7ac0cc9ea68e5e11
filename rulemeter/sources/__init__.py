"""rulemeter.sources."""
