"""Operators for training-data pipelines: filtering, near-duplicate joins, mixing, packing,
sharding, scoring and extraction. Nothing else in the library imports this subpackage."""
