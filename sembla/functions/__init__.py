"""functions of sembla."""
