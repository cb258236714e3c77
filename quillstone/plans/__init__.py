"""Queries of the evidence operators over the driver's tables."""
