"""Column-level building blocks: fixed values, prompts, hashing, metrics."""
