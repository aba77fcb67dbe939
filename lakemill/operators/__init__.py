"""Composite operators over review-style facts."""
