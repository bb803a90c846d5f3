"""Statuta: regulatory-text and compliance analytics as PySpark DataFrame operators."""
