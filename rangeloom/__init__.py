"""Range-filtered nearest-neighbour analytics on Spark."""
