"""Archived responses in, typed tables out; and the tables' writers."""
