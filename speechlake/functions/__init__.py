"""Part of speechlake."""
