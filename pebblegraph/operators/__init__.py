"""Steps on node, edge and assignment tables."""
