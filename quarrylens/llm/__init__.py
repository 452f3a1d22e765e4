"""Training-data operators: language ID, near-duplicate joins, packing, sharding and their kin."""
