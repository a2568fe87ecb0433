"""Every query by name, and the SQL that checks it."""

from __future__ import annotations

from lodestone.plans import captured, exchange, feeds, forms, harvest, resolve, responses, search, star, streams, texts

PLANS = (feeds, search, texts, resolve, star, streams, exchange, forms, harvest, captured, responses)
QUERIES = {name: query for plan in PLANS for name, query in plan.QUERIES.items()}
ORACLE_SQL = {name: sql for plan in PLANS for name, sql in plan.ORACLE_SQL.items()}
