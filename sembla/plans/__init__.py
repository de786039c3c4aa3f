"""plans of sembla."""
