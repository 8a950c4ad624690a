"""sources of siltstone."""
