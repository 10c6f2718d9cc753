"""Verification over streams."""
