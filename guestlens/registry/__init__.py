"""Named queries over the test tables and the SQL they are checked against."""

from __future__ import annotations

from guestlens.registry.base import ENTRIES, Entry


def all_entries() -> dict[str, Entry]:
    from guestlens.registry import analysis, columns, models  # noqa: F401

    return dict(ENTRIES)
