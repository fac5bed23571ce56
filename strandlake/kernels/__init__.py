"""Geometry and alignment in numpy; no Spark in here."""
