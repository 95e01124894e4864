"""Point-in-time panel analytics for Spark DataFrames."""
