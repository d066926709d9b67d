"""Table, document, JSON-lines and rendered-text sources and sinks."""
