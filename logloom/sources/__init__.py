"""Sources and sinks: test-table views, raw/structured log scans, run logs."""
