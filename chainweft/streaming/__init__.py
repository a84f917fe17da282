"""Structured Streaming forms of the block, activity and alert operators."""
