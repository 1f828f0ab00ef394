"""Sources and sinks: export files, record tables, snapshots."""
