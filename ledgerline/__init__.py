"""Event-log analytics expressed as DataFrame, SQL and Structured Streaming plans."""
