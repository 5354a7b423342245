"""formgrain.functions."""
