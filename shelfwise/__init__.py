"""Catalog matching and price analytics as PySpark DataFrame operators."""
