"""Live counters and incremental plan updates with Structured Streaming."""
