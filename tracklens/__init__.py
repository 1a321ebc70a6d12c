"""Analytics on ordered series, trajectories and experiment outcomes, built on Spark DataFrames."""
