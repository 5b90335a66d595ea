"""All queries of the subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from corpusloom.llm import cut, encode, grouped, mixture, overlap, pairs, subjects

_MODULES = (pairs, overlap, cut, grouped, encode, mixture, subjects)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL = {name: text for m in _MODULES for name, text in m.SQL.items()}
