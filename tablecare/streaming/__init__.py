"""The same pass on files as they arrive, through Structured Streaming."""
