"""Readers, writers, paging and the test-table views."""
