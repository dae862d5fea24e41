"""Reports by name with a strict parameter check: missing and unknown names are refused before anything runs."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame

from . import questions, reports
from .warehouse import Warehouse

REPORTS: dict[str, Callable[..., DataFrame]] = {
    name: f
    for module in (reports, questions)
    for name, f in vars(module).items()
    if inspect.isfunction(f) and not name.startswith("_") and next(iter(inspect.signature(f).parameters), None) == "w" and f.__module__ in (reports.__name__, questions.__name__)
}


def parameters(name: str) -> dict[str, bool]:
    """Parameter names of a report, and which must be given."""
    if name not in REPORTS:
        raise ValueError(f"no report {name}")
    own = list(inspect.signature(REPORTS[name]).parameters.values())[1:]
    return {p.name: p.default is inspect.Parameter.empty for p in own}


def run_report(w: Warehouse, name: str, **given: Any) -> DataFrame:
    known = parameters(name)
    missing = sorted(k for k, must in known.items() if must and k not in given)
    unknown = sorted(set(given) - set(known))
    if missing or unknown:
        raise ValueError(f"{name}: missing {missing}, unknown {unknown}")
    return REPORTS[name](w, **given)
