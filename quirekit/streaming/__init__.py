"""Structured Streaming forms of the chunk, cache and line operators (STM family)."""
