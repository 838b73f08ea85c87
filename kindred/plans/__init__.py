"""Reusable plan shapes: running aggregates, span sweeps, spines, lookups and hash draws."""
