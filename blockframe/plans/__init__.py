"""From expression text to DataFrame plans."""
