"""Composite plans: combine, serving queries and data-quality audits."""
