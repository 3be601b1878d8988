"""Evaluation of streams."""
