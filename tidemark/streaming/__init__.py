"""Lifecycle: downsampling, continuous aggregates, retention, tiering, sharding."""
