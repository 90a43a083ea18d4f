"""Query registry, fixtures and shared plan helpers."""
