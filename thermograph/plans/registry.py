"""All registered queries: name -> (Spark callable, reference SQL or None)."""

from __future__ import annotations

from functools import cache


@cache
def registered() -> dict:
    from thermograph.plans import registry_drawing, registry_energy, registry_faces, registry_sources, registry_tables, registry_text, registry_web

    out: dict = {}
    for module in (registry_energy, registry_text, registry_tables, registry_drawing, registry_web, registry_sources, registry_faces):
        for name, pair in module.QUERIES.items():
            if name in out:
                raise ValueError(f"duplicate query {name}")
            out[name] = pair
    return out
