"""Registered queries and their SQL twins over the driver tables."""
