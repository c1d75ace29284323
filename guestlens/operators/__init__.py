"""Reusable DataFrame operators: ranking, matching, filtering, aggregating."""
