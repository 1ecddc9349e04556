"""plans of glyphmill."""
