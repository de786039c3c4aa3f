"""sources of sembla."""
