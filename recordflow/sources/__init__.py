"""Sources and sinks: files, sequence formats and the results store."""
