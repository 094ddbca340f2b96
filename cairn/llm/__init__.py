"""Training-data operators: mixing, packing, near-duplicates, quality, archives, shards, scans."""
