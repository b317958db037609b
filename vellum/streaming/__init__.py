"""Keeping an index in step with a stream of changes."""
