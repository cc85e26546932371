"""Operators on masks, pixel graphs, vector layers, statistics and audits."""
