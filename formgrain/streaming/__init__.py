"""formgrain.streaming."""
