"""Queries over a data folder, with their SQL twins."""
