import hashlib

import pytest

from millrace.llm import exact_dedup


def brute(rows, largest):
    by = {}
    for i, t, *_ in rows:
        by.setdefault(t or "", []).append(i)
    out = []
    for i, t, *_ in rows:
        ids = [x for x in by[t or ""] if x is not None]
        keep = (max if largest else min)(ids) if ids else None
        out.append((i, keep, len(by[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(i, f"text {i % 7}" if i % 3 else f"own {i}", i) for i in range(90)] + [(200, None, 1), (201, "", 1), (202, " ", 1), (None, "text 1", 1), (None, "lonely", 1), (300, "twice", 1), (300, "twice", 2), (301, "Ä" * 50_000, 1)]


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_groups_and_flags(spark, keep):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, kept int").repartition(5)
    got = exact_dedup.exact_dedup(df, keep).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(ROWS, keep == "largest")
    kept = [r.text_sha256 for r in got if r.kept]
    assert len(kept) == len(set(kept)) == len({t or "" for _, t, _ in ROWS})


def test_dropping_keeps_columns(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, kept int")
    out = exact_dedup.drop_copies(df, "largest")
    assert out.columns == df.columns
    rows = out.collect()
    assert len(rows) == len({t or "" for _, t, _ in ROWS})
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0 and exact_dedup.drop_copies(df.limit(0)).count() == 0


def test_a_fold_is_verified(spark):
    import pyarrow as pa
    import numpy as np

    batch = pa.RecordBatch.from_pydict({"node": [0, 0], "digest": [b"x" * 32] * 2, "n_bytes": [1, 2], "check": [5, 5], "keep_id": [1, 2], "n": [1, 1]})
    with pytest.raises(ValueError, match="differ"):
        list(exact_dedup._fold(True, 0, 7)(iter([batch])))
    assert np.iinfo(np.int64).min == exact_dedup._NULL
