"""Readers and writers of graph and seed files."""
