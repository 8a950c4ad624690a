"""plans of siltstone."""
