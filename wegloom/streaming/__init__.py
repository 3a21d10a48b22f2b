"""Streaming of the road-network engine."""
