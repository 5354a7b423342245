"""formgrain.plans."""
