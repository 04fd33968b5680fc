"""Nearest-neighbour scoring on Spark: features, quantisation, exact and inverted-file search, votes, decisions."""
