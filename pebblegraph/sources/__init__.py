"""Graphs from files, generators and tables."""
