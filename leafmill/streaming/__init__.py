"""Structured Streaming counterparts of the stateful behaviours."""
