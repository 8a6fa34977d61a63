"""Structured Streaming jobs applying the detection rules to arriving rows."""
