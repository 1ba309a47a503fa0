"""Readers for raw records and model files, and the split sink."""
