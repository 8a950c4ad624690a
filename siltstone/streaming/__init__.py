"""streaming of siltstone."""
