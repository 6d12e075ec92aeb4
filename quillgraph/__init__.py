"""Graph analytics over code and document graphs, as lazy Spark DataFrames."""
