"""Relational operators over graphs: construction, weights, sampling, components, selection, cascades."""
