"""Operators for training data: neighbours, clusters, leaked tests, mixes, cut texts."""
