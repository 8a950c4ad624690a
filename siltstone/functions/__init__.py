"""functions of siltstone."""
