"""Column functions: types, times, text rendering, bands and axes."""
