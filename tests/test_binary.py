import json

import numpy as np
import pytest

from millrace.sources import binary


def put(root, name, *shards, dtype="uint16", **meta):
    """Document i of a shard has the ids i, i + 1, ..."""
    path = root / name
    path.mkdir()
    for k, lengths in enumerate(shards):
        ids = [np.arange(i, i + n, dtype=dtype) for i, n in enumerate(lengths)]
        (np.concatenate(ids) if ids else np.zeros(0, dtype)).tofile(path / f"part-{k:06d}.bin")
        np.save(path / f"part-{k:06d}.bin.lengths.npy", np.asarray(lengths, np.uint32))
    full = {"complete": True, "vocab_size": 1000, "dtype": dtype, "documents": sum(map(len, shards)), "tokens": sum(map(sum, shards)), "shards": len(shards), "shard_files": [f"part-{k:06d}.bin" for k in range(len(shards))]}
    (path / "corpus.json").write_text(json.dumps({k: v for k, v in (full | meta).items() if v is not None}))
    return path


@pytest.mark.parametrize("dtype,range_bytes", [("uint16", 1 << 26), ("uint16", 4), ("uint32", 40)])
def test_shards_by_ranges(spark, tmp_path, monkeypatch, dtype, range_bytes):
    shards = ([2, 3, 0, 4, 5, 6, 7, 0], [], [101] * 10, [0, 0], [3] * 100)
    path = put(tmp_path, "c", *shards, dtype=dtype, shard_files=None)
    df = binary.read_binary(spark, str(path), 1000, range_bytes=range_bytes)
    got = sorted((r.shard, r.doc, list(r.ids), r.n_tokens) for r in df.collect())
    assert got == [(k, i, list(range(i, i + n)), n) for k, s in enumerate(shards) for i, n in enumerate(s)]
    if range_bytes < 100:
        assert df.rdd.getNumPartitions() > 50


def test_one_file_without_metadata(spark, tmp_path):
    path = put(tmp_path, "c", [2, 3], dtype="uint32")
    assert binary.read_binary(spark, str(path / "part-000000.bin"), 100_000).count() == 2


def test_refusals(spark, tmp_path):
    read = lambda p, sha=None, size=1000: binary.read_binary(spark, str(p), size, sha).collect()
    aa = put(tmp_path, "aa", [3, 3], tokenizer_sha256="aa")
    assert len(read(aa, "AA")) == 2 and len(read(put(tmp_path, "none", [3]), "aa")) == 1
    with pytest.raises(ValueError, match="fingerprint mismatch"):
        read(aa, "bb")
    for i, (change, match) in enumerate((
        ({"complete": False}, "not marked complete"), ({"vocab_size": None}, "vocabulary"), ({"vocab_size": 999}, "vocabulary"), ({"format_version": 2}, "tokenizer_sha256"), ({"dtype": None}, "no dtype"), ({"dtype": "int32"}, "unsupported dtype"),
        ({"shard_files": []}, "invalid shard_files"), ({"shard_files": ["../x.bin"]}, "invalid shard_files"), ({"shard_files": ["part-000000.bin"] * 2}, "invalid shard_files"), ({"shard_files": ["other.bin"]}, "missing .'other.bin'"),
        ({"shard_files": None, "shards": 0}, "shard count"), ({"shard_files": None, "shards": 2}, "missing .'part-000001.bin'"), ({"documents": 3}, "documents: declared 3, found 2"), ({"tokens": None}, "tokens"), ({"shards": 2}, "for shards"),
    )):
        with pytest.raises(ValueError, match=match):
            read(put(tmp_path, f"c{i}", [3, 3], **change))
    bad = put(tmp_path, "bad", [3, 3])
    (bad / "part-000009.bin").write_bytes(b"")
    with pytest.raises(ValueError, match="extra .'part-000009.bin'"):
        read(bad)
    (bad / "part-000009.bin").unlink()
    (bad / "part-000000.bin").write_bytes(b"\0" * 10)
    with pytest.raises(Exception, match="corrupt shard"):
        read(bad)
    (bad / "part-000000.bin.lengths.npy").unlink()
    with pytest.raises(Exception, match="missing document lengths"):
        read(bad)
    (bad / "corpus.json").write_text("[")
    with pytest.raises(ValueError, match="invalid corpus metadata"):
        read(bad)
    (bad / "corpus.json").unlink()
    with pytest.raises(ValueError, match="no corpus.json"):
        read(bad)
