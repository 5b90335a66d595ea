import os
import sys
from datetime import datetime, timezone
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("PYARROW_IGNORE_TIMEZONE", "1")

DATA = os.environ.get("TESTDATA_DIR", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from corpusloom.session import local_session

    s = local_session(4, 4, "4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def sf():
    return f"{DATA}/sf0.001"


_TS = pa.timestamp("us", tz="UTC")
TEXTS = pa.schema([("id", pa.string()), ("text", pa.string()), ("is_ai", pa.bool_()), ("label", pa.string()), ("source", pa.string()), ("domain", pa.string()), ("author_id", pa.string()), ("model", pa.string()), ("exam_type", pa.string()), ("prompt", pa.string()), ("source_text_id", pa.string()), ("text_length_words", pa.int32()), ("split", pa.string()), ("ingested_at", _TS)])
SCHEMAS = {
    "human_texts": TEXTS,
    "ai_texts": TEXTS,
    "rewritten_texts": TEXTS,
    "humanized_texts": TEXTS,
    "detector_scores": pa.schema([("score_id", pa.string()), ("detector", pa.string()), ("id", pa.string()), ("y_true", pa.int32()), ("y_pred", pa.int32()), ("y_score", pa.float64()), ("raw", pa.string()), ("scored_at", _TS)]),
    "removal_log": pa.schema([("entry_id", pa.int64()), ("id", pa.string()), ("entry_type", pa.string()), ("logged_at", _TS), ("reason", pa.string())]),
    "documents": pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), ("author_id", pa.string()), ("model", pa.string()), ("ingested_at", _TS)]),
    "subject_labels": pa.schema([("doc_id", pa.int64()), ("annotator", pa.string()), ("subject", pa.string())]),
    "subject_areas": pa.schema([("subject", pa.string()), ("description", pa.string())]),
    "mix_targets": pa.schema([("recipe", pa.string()), ("source", pa.string()), ("target_share", pa.float64()), ("max_repeats", pa.int32())]),
}
#: Names that the operators use for columns of their own.
CLASHING = ["k", "at", "fp", "n", "h", "block", "side", "ws", "root", "label_", "seen", "original", "mask", "cells", "ids", "defect", "head", "core", "r"]


def day(n):
    return datetime(2024, 1, 1, tzinfo=timezone.utc).replace(day=1 + n % 28, month=1 + n // 28 % 12)


@pytest.fixture
def tables(tmp_path):
    """tables(name=[row dicts], ...) writes all tables (others empty) with extra columns of clashing names; gives the folder."""

    def make(**given):
        for name, schema in SCHEMAS.items():
            rows = given.get(name, [])
            for i, r in enumerate(rows):
                for c in ("ingested_at", "scored_at", "logged_at"):
                    if c in schema.names:
                        r.setdefault(c, day(i))
            cols = {f.name: pa.array([r.get(f.name) for r in rows], f.type) for f in schema}
            cols |= {c: pa.array([f"x{i}" for i in range(len(rows))], pa.string()) for c in CLASHING if c not in cols}
            pq.write_table(pa.table(cols), tmp_path / f"{name}.parquet")
        return str(tmp_path)

    return make
