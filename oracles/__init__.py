"""Oracle SQL for every registered query that plain SQL can express."""

from __future__ import annotations

from . import page_queries, report_queries, site_queries

ALL: dict[str, str] = {**page_queries.ORACLES, **site_queries.ORACLES, **report_queries.ORACLES}
