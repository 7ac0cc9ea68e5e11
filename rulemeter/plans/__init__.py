"""rulemeter.plans."""
