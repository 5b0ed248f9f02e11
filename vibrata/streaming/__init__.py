"""The window operators over Structured Streaming."""
