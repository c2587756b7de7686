"""Layered conversation-memory analytics on Spark."""
