"""Readers for files, rules, road tables and change streams."""
