"""Readers, writers and the derived input views."""
