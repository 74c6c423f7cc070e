"""Column functions: durations, aggregates, time buckets."""
