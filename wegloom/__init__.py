"""wegloom: road-network analytics and routing, expressed as Spark DataFrames."""
