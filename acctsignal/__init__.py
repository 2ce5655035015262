"""Account and post analytics on Spark: features, graphs, follower runs, models."""
