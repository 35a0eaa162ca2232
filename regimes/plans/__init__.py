"""Pipelines and the catalogue of registered queries."""
