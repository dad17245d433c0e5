"""Named queries over the given tables."""

from importlib import import_module

GROUPS = ["behaviour", "features", "detector", "evaluation", "search", "analytics", "joins", "triage", "parsing", "collection",
          "sources", "ensemble", "models", "streams"]


def load() -> None:
    """Import every query group so that it registers itself."""
    for group in GROUPS:
        import_module(f"logwarden.plans.{group}_queries")
