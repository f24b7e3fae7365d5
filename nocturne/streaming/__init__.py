"""Heart-rate messages as Structured Streaming; every function also takes batch input."""
