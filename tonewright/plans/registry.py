"""Named queries over the driver's tables, with their SQL for DuckDB."""

from __future__ import annotations

import importlib.util

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _part in ("note_queries", "grid_queries", "tempo_queries", "scalar_queries", "media_queries", "document_queries"):
    if importlib.util.find_spec(f"{__package__}.{_part}"):
        _module = importlib.import_module(f"{__package__}.{_part}")
        QUERIES |= _module.QUERIES
        ORACLES |= _module.ORACLES
