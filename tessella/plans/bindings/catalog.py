"""All bound queries by name."""

from __future__ import annotations

from tessella.plans.bindings import codes, coding, features, governance, integrity, rasters, reports, streams, textfiles
from tessella.plans.bindings.common import Bound

_MODULES = (integrity, governance, features, rasters, codes, coding, reports, textfiles, streams)

CATALOG: dict[str, Bound] = {}
for _module in _MODULES:
    for _name, _bound in _module.BOUND.items():
        if _name in CATALOG:
            raise ValueError(f"query {_name!r} is bound twice")
        CATALOG[_name] = _bound
