"""Event-graph queries over long sequences, expressed as Spark DataFrames."""
