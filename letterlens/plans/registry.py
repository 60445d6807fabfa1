"""The registered queries of the engine and their DuckDB SQL, by name."""

from __future__ import annotations

from letterlens.plans import queries as _queries
from letterlens.plans.oracles import ORACLES  # noqa: F401

QUERIES = {name: f for name, f in vars(_queries).items() if callable(f) and getattr(f, "__module__", "") == _queries.__name__ and not name.startswith("_")}
flagship = _queries.flagship_verdicts
