"""All queries and SQL twins of the library itself."""

from __future__ import annotations

from . import analytics, cleaning, context, extraction, features, flows, storage, textual

MODULES = (cleaning, analytics, storage, textual, flows, context, extraction, features)
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
SQL = {name: q for m in MODULES for name, q in m.SQL.items()}
