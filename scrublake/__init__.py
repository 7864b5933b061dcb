"""Page-privacy analytics as DataFrame transformations on Spark."""
