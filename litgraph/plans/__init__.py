"""Jobs over whole tables, and the registered queries."""

from importlib import import_module

MODULES = ("q_filters", "q_joins", "q_rollups", "q_ranking", "q_graph", "q_retrieval", "q_text", "q_sources",
           "q_resolution", "q_corrections", "q_streams")


def load_all() -> None:
    import pkgutil
    here = {m.name for m in pkgutil.iter_modules(__path__)}
    for m in MODULES:
        if m in here:
            import_module(f"{__name__}.{m}")
