"""Column functions and driver-side constants."""
