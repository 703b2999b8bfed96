"""Resumable views of a filtration."""
