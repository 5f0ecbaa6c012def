"""Named queries over the driver tables, grouped by operator family."""

import importlib

FAMILIES = ["reshape", "windows", "joins", "aggregates", "scoring", "resample", "align", "text", "models", "sources"]


def load():
    """Import every family once and return the filled registry."""
    from spanaccord.plans import registry

    for f in FAMILIES:
        importlib.import_module(f"spanaccord.plans.q_{f}")
    return registry
