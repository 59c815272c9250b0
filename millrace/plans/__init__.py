"""Sessions, shared storage, shards and the query catalogue."""
