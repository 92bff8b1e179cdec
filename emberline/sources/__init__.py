"""Event sources and result sinks."""
