"""Registered queries over the sample tables and their SQL twins."""
