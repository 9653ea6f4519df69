import pytest

from millrace.sources import files


@pytest.mark.parametrize("name", ["utf-16-le", "utf-16-be", "utf-32-le", "utf-32-be"])
@pytest.mark.parametrize("end", ["\n", ""])
def test_wide_files_are_cut_and_no_line_is_lost(spark, tmp_path, name, end):
    # letters with a byte 0x0A, also such that two neighbours look like a newline between them
    texts = [f"{i} 上ਅĀ਀Ċ\u000b{'ä😀ਊĊ' * (i % 17)}." + ("上" * 900 if i % 50 in (0, 7) else "") for i in range(90)]
    path = tmp_path / "a.jsonl"
    path.write_bytes(("﻿" + "\n".join(texts) + end).encode(name))
    (tmp_path / "b.jsonl").write_bytes("﻿one\n\ntwo".encode(name))
    paths = [str(path), str(tmp_path / "b.jsonl")]
    for cut in ("701b", "64k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", cut)
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        try:
            df = files.text_lines(spark, paths)
            got = df.where("line <> ''").orderBy("file", "begin", "id").collect()
            splits = df.select("file", "begin").distinct().count()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert [r.line for r in got] == [*texts, "one", "two"]
        assert cut == "64k" or splits > 10


def test_odd_wide_files(spark, tmp_path):
    raw = {"mark": b"\xff\xfe", "cut": b"\xff\xfea\x00\n\x00b\x00\x0a", "half": "﻿a\nb".encode("utf-16-be") + b"\x00", "empty": b""}
    for name, data in raw.items():
        (tmp_path / f"{name}.txt").write_bytes(data)
    paths = [str(tmp_path / f"{n}.txt") for n in raw]
    got = files.text_lines(spark, [*paths, paths[1]], {paths[3]: "utf-16"}).where("line <> ''").collect()
    assert sorted(r.line for r in got) == sorted(["a", "b�"] * 3)
