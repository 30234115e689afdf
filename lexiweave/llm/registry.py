"""Names of the corpus queries and the SQL of those that SQL can express."""

from __future__ import annotations

from . import queries as q
from .sql import ORACLES


def queries() -> dict:
    return {name: f for name, f in vars(q).items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
