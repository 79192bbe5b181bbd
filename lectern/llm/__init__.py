"""Operators for large training-data pipelines (optional; nothing else imports them)."""
