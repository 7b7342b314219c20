"""Recordings: the wire format, Spark sources and sinks, the catalog and exports."""
