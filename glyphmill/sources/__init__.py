"""sources of glyphmill."""
