"""Place-ranking analytics on Spark: clean, join, derive, rank, score and explain keyed entities."""
