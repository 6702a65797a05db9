"""Part of textlake."""
