"""Sources and sinks: driver-table bridge, raw event tables, provider responses."""
