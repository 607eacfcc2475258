"""Table profiling and view ranking on Spark DataFrames."""
