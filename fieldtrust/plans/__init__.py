"""Composed plans: verification, review loops and the evaluation harness."""
