"""Sources and sinks of graph tables."""
