"""Query plans: fixture views, the query registry and the per-area query keys."""


def load_all():
    """Import every query module so its keys register."""
    from posttrain.plans import q_rollouts  # noqa: F401
    import importlib
    import pkgutil
    import posttrain.plans as pkg
    for m in pkgutil.iter_modules(pkg.__path__):
        if m.name.startswith("q_"):
            importlib.import_module(f"posttrain.plans.{m.name}")
