"""Palimpsest: glyph-page transcription, text repair and text-quality analytics as Spark jobs."""
