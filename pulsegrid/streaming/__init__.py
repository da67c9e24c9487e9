"""Streams: requests of which only the newest counts."""
