"""Structured Streaming jobs over the edit log and over arriving patches."""
