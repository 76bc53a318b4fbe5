"""Sources: test-table logs, parquet snapshots, Kafka options."""
