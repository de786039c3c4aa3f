"""llm of sembla."""
