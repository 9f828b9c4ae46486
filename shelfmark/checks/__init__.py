"""All registered checks."""

from shelfmark.checks.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "load"]


def load() -> None:
    """Import the check modules so that they register themselves."""
    from shelfmark.checks import corpus, ledger, retrieval, texts  # noqa: F401
