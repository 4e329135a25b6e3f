"""All registered queries: importing the modules fills the tables."""

from __future__ import annotations

from tidemark.plans import feeds, intake, people, queries, reports, rules, stores, streams, texts

MODULES = (queries, texts, people, reports, stores, streams, intake, rules, feeds)
QUERIES, ORACLE_SQL = queries.QUERIES, queries.ORACLE_SQL
