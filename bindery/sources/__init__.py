"""Sources and sinks of ebooks."""
