"""Sources and sinks of documents and reports."""
