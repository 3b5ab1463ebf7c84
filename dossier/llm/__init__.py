"""Training-data operators: tokenising, filtering, deduplication, sharding and privacy on Spark.

Nothing outside this package imports it, so the rest of the library works without it.
"""
