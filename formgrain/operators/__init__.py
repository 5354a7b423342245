"""formgrain.operators."""
