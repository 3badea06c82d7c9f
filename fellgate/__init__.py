"""Queries over nodes, ways and relations with open tags, as lazy Spark DataFrames."""
