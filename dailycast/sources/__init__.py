"""Sources and sinks: transaction scans, test-table adapters, model store, registry."""
