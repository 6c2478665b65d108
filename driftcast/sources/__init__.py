"""Readers, sinks and the roles that tables play."""
