"""Tables and record files."""
