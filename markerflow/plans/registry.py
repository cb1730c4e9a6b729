"""All queries outside the llm subpackage, by name, and their SQL."""

from __future__ import annotations

from markerflow.plans import augmenting, catalogue, chunking, comparing, labelling, quality, records, sequences, solving, spatial

MODULES = [sequences, chunking, labelling, catalogue, records, spatial, augmenting, comparing, solving, quality]

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
