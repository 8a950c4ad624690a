"""operators of siltstone."""
