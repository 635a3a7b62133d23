"""Grouped-sum analytics on Spark: one query shape, exact semantics, everything else refused by name."""
