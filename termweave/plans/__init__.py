"""Whole jobs over the driver tables: fixtures, registered queries and their SQL."""
