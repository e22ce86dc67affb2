"""graphlens: property-graph, log and corpus analytics as Spark DataFrames."""
