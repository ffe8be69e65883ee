"""Raw dumps, canonical tables and their sinks."""
