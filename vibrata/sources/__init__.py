"""Readers that give long-form signals, a generator of test signals, and sinks."""
