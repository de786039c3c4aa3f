"""operators of sembla."""
