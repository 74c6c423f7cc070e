"""From requests to plans: query compiler, SQL dialect, catalog, engine."""
