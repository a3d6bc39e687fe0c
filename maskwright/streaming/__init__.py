"""Stateful streams: sessions, limits, breakers."""
