"""Spark operators that turn pages, feeds and extracted records into a verified intelligence feed."""
