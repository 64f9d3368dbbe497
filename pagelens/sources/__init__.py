"""Sources and sinks: tables, page cache, exports."""
