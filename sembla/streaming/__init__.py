"""streaming of sembla."""
