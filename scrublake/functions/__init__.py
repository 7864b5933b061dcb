"""Column functions: browser-style text handling, match offsets, geometry."""
