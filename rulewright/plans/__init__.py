"""Registered queries with their comparison SQL, and end-to-end flows."""
