"""Column-level building blocks: masking and typed comparison values."""
