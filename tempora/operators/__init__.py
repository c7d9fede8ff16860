"""Operators on DataFrames: segments, events, signals, geometry, densities, decoding."""
