"""Registered queries over the given tables."""


def load() -> None:
    """Import every module that registers queries."""
    from frostline.catalog import models, requests, series, stats, storage  # noqa: F401
