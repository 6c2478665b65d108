"""Receivers as keyed streaming state."""
