"""Spark-native analytics for agent trajectories, task specifications and training-data curation."""
