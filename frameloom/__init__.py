"""Episode analytics on Spark: catalogue, integrity, trimming, actions, statistics, windows, evaluation, streams."""
