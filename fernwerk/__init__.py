"""Learning and evaluation operators over Spark DataFrames."""
