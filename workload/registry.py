"""All registered queries: key -> (DataFrame function, DuckDB SQL or None)."""

from __future__ import annotations

import importlib

MODULES = ["sources", "cleaning", "joins", "aggregates", "sequences", "selection", "features", "resampling", "learning", "ensembles", "streams"]


def registry() -> dict:
    out: dict = {}
    for name in MODULES:
        try:
            module = importlib.import_module(f"workload.{name}")
        except ModuleNotFoundError as e:
            if e.name != f"workload.{name}":
                raise
            continue
        clash = set(out) & set(module.QUERIES)
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out.update(module.QUERIES)
    return out
