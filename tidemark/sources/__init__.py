"""Sources and sinks: line protocol, Parquet import, partitioned tables, generators."""
