"""textloom: text-pair analytics on Spark (see README.md)."""
