"""Sources and sinks: the binary event-file data source and file-name fields."""
