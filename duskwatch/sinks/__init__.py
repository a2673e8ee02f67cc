"""Stored results: caches, task results, audit appends, bounded previews, reports."""
