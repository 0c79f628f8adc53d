"""Relation-graph analytics and retrieval over sequential text, as DataFrame transformations."""
