"""Whole workflows and the command line."""
