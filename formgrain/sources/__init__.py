"""formgrain.sources."""
