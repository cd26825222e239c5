"""Replay-safe writers."""
