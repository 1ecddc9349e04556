"""streaming of glyphmill."""
