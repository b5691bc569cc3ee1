"""Readers and writers of scans, configurations, transforms and results."""
