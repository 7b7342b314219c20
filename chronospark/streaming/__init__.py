"""Streams: fresh values of silent channels, lateness, growing recordings."""
