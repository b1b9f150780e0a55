"""Captured pages in, catalogue tables out."""
