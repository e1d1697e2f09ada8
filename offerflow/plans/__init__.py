"""The registered queries: input views, Spark plans and their SQL twins."""

from importlib import import_module

MODULES = ("rows", "tables", "ranks", "samples", "scores", "bands", "budgets", "quotas", "models", "jobs")


def load_all() -> None:
    for name in MODULES:
        import_module(f"offerflow.plans.{name}")
