import random
import re
from collections import Counter

import pytest

from millrace.llm import jaccard


def brute(rows):
    """(doc_id, n, component) by comparing every pair that shares a shingle."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    by, parent = {}, list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for j, s in enumerate(sets):
        shared = Counter(i for t in s for i in by.get(t, ()))
        for i, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[i]) - n):
                a, b = sorted((find(i), find(j)), key=lambda x: rows[x][0])
                parent[b] = a
        for t in s:
            by.setdefault(t, []).append(j)
    return sorted((d, len(s), rows[find(i)][0]) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def got(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect())


def test_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.op9(spark, sf).collect()) == brute(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_and_thresholds(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "STAR_ROUNDS", seed - 1)
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(30)]
    rows = []
    for g in range(6):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([6, 20, 60]))] + common * (g % 2)
        for _ in range(12):
            rows.append((len(rows), " ".join(words)))
            words = list(words)
            for _ in range(rng.choice([0, 1, 1, 2])):
                words[rng.randrange(len(words))] = f"x{rng.randrange(1000)}"
    assert got(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  b"), (6, "a"), (7, "a b c d e"), (8, "a b c d e "), (9, "a b c d e")]
    assert got(spark, rows) == brute(rows)
    assert jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "x y", 1), (4, "x y", 2), (4, "x y", 3)], "doc_id long, text string, n int")
    assert sorted(map(tuple, jaccard.jaccard_components(odd).fillna(-1).collect())) == [(-1, 1, 4), (4, 1, 4), (4, 1, 4)]
    assert jaccard.keep_one(odd).columns == odd.columns


def test_an_excerpt_as_first_centre_hides_no_pair(spark):
    groups = []
    for g in range(150):
        w = [f"g{g}w{i}" for i in range(104)]
        groups.append([" ".join(w), " ".join(w[:94] + [f"g{g}x{i}" for i in range(10)]), " ".join(w[:78])])
    df = spark.createDataFrame([(3 * g + k, t) for g, own in enumerate(groups) for k, t in enumerate(own)], "doc_id long, text string")
    rows = {r.doc_id: r for r in jaccard.profiles(df).collect()}
    hidden = [g for g in range(150) if set(rows[3 * g].p0) <= set(rows[3 * g + 2].tokens)]
    assert hidden
    one = list(enumerate(groups[hidden[0]]))
    assert got(spark, one) == brute(one) and brute(one)[1][2] == 0


def test_what_was_sent_is_not_held_beside_the_profiles(spark):
    docs = spark.createDataFrame([(i, f"a b c d e f {i // 2}") for i in range(20)], "doc_id long, text string")
    plan = jaccard.profiles(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" in plan and plan.count("FlatMapGroupsInArrow") == 1  # buckets' answers are a table, their exchange is over


def test_only_nodes_of_pairs_move_to_be_verified(spark, tmp_path):
    row = lambda i: (i, 8, list(range(8)), [1], [2], [3], 0.0)
    nodes = spark.createDataFrame([row(i) for i in range(500)], "node long, n long, tokens array<long>, p0 array<long>, p1 array<long>, p2 array<long>, mass double")
    pairs = spark.createDataFrame([(1, 2), (2, 7)], "a long, b long")
    nodes.write.parquet(str(tmp_path / "nodes"))
    pairs.write.parquet(str(tmp_path / "pairs"))
    nodes, pairs = spark.read.parquet(str(tmp_path / "nodes")), spark.read.parquet(str(tmp_path / "pairs"))
    assert sorted(r.node for r in jaccard._named(pairs, nodes).collect()) == [1, 2, 7]
    assert sorted(map(tuple, jaccard._verified(pairs, nodes).collect())) == [(1, 2), (2, 7)]


def test_tokens_of_nodes_without_pairs_stay_where_no_table_is_small(spark):
    row = lambda i: (i, 40, list(range(i * 100, i * 100 + 40)), [i * 100], [i * 100], [i * 100], 1.0)
    nodes = spark.createDataFrame([row(i) for i in range(50)], "node long, n long, tokens array<long>, p0 array<long>, p1 array<long>, p2 array<long>, mass double")
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = jaccard._named(pairs, nodes)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
