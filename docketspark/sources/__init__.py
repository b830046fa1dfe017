"""Sources and sinks: tables, stored objects, request bodies."""
