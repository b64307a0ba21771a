"""Reusable relational operators: latest version, as-of, runs, ranks, calendar."""
