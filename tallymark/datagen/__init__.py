"""Deterministic tables with known, counted differences."""
