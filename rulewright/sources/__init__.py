"""Readers, sinks and the derived tables used by the registered queries."""
