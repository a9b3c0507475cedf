"""End-to-end batch plans and the query catalogue."""
