"""All queries of the core, with the SQL that gives the same result where SQL can express it."""

from __future__ import annotations

from corpusloom.operators import corpus, detect, features, lookups, metrics, models, orphans, splits
from corpusloom.sources import round_trips
from corpusloom.streaming import ingest

_MODULES = (orphans, corpus, splits, features, metrics, lookups, detect, models, round_trips, ingest)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL = {name: text for m in _MODULES for name, text in m.SQL.items()}
SQL["result_folder"] = "select detector, accuracy, macro_f1 from (" + metrics.SQL["confusion_f1"] + ")"
