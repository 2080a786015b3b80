"""Relational operators: sets, frames and slots, indices and search, keyed tables, pools, closures."""
