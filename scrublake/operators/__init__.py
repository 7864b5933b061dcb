"""Detection, merging, geometry and text operators."""
