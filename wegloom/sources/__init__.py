"""Sources of the road-network engine."""
