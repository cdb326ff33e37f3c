"""Readers and writers: snapshots, CSV archives, paged JSON, records, manifests."""
