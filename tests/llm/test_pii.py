import hashlib
import re

from millrace.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def check(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (texts[r.doc_id], r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in PATTERNS]
        assert set(want) <= set(r.spans.split(",")) | {""}


def test_documents(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check(pii.op8(spark, sf).collect(), texts)


ODD = [
    None, "", "é🙂 a@b.c x@y.zz_q@r.st", "a@b..c a@b a@b.c.d. @x.y", "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3 001.002.003.0255", "4111 1111 1111 1111 4111-1111-1111-1112",
    "+1 (743) 555-3824, +49()..- +123456789 +1", "1" * 5000, "1 " * 3000, "a" * 20000 + "@" + "b." * 3000 + "c", "+1" * 2000, "é+1 222 333 4444é5@6.7",
    "123.123.123.123.4 12.34.56.78a@b.c", "4111111111111111\n4111 1111 1111 1111", "--@--.--", "1.1.1.1" * 300,
]


def test_odd_texts(spark):
    texts = dict(enumerate(ODD))
    df = spark.createDataFrame([(k, v, 1) for k, v in texts.items()], "doc_id long, text string, base int")
    check(pii.report(df).collect(), texts)
    assert pii.report(df.limit(0)).count() == 0


def test_contexts_discover_unseen_identifiers(spark):
    rows = [(i, f"blah {i % 7}x please call me +1 (555) 010-{1000 + i} today") for i in range(40)]
    rows += [(100, "so please call me 555-010-4242, today"), (101, "room 555-010-4243 is clean"), (102, "please call me tomorrow 12")]
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100].spans == "phone:18:30" and got[100].n_phone == 0
    assert got[101].spans == "" and got[102].spans == ""


def test_redact_keeps_columns(spark):
    df = spark.createDataFrame([(1, "mail a@b.cc or +1 222 333 4444.", "x", 5), (2, None, None, None), (3, "clean", "y", 1)], "doc_id int, text string, lang string, row int")
    out = {r.doc_id: r for r in pii.redact(df).collect()}
    assert pii.redact(df).columns == df.columns
    assert out[1].text == "mail [EMAIL] or [PHONE]." and out[2].text is None and out[3].text == "clean" and out[1].row == 5


def spans_with_context(text, pattern):
    at = 0
    for m in re.finditer(pattern, text):
        yield m, text[at : m.start()][-pii.CONTEXT :]
        at = m.end()


def pattern_of(left):
    words = re.search(r"(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+)?[^\x20\x09-\x0D]*[\x20\x09-\x0D]*\Z", left).group()
    return re.sub(r"[\x20\x09-\x0D]+", " ", words).strip(" ").lower()


def loose_kind(v):
    n = len(re.sub("[^0-9]", "", v))
    tests = (r"[^@]+@[^@]+", r"[^0-9]*[0-9]+(?:[.:][0-9]+){3,7}[^0-9]*", r"[0-9 -]+", r"[+(]?[0-9().-]+")
    for k, p in enumerate(tests):
        if re.fullmatch(p, v) and (k < 2 or (12 <= n <= 19 if k == 2 else 7 <= n <= 15)):
            return k
    return -1


def brute_spans(texts):
    """All spans of every text, the graph scored by plain loops."""
    kinds, base, loose = list(PATTERNS), {}, {}
    for i, t in texts.items():
        t = t or ""
        held = {(w.split(":")[0], int(w.split(":")[1])) for w in brute(t)}
        base[i] = [(k, m.start(), m.end(), m.group().lower(), pattern_of(left)) for k, kind in enumerate(kinds) for m, left in spans_with_context(t, PATTERNS[kind]) if (kind, m.start()) in held]
        loose[i] = []
        for m, left in spans_with_context(t, r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*[0-9@][^\x20\x09-\x0D]*"):
            v = m.group()
            letter = lambda c: c.isalpha() or c in "0123456789"
            a, z = 0, len(v)
            while a < z and not (letter(v[a]) or v[a] in "+("):
                a += 1
            while z > a and not letter(v[z - 1]):
                z -= 1
            s, e = m.start() + a, m.start() + z
            if e > s and not any(b[1] < e and b[2] > s for b in base[i]):
                loose[i].append((loose_kind(v[a:z]), s, e, v[a:z].lower(), pattern_of(left)))
    edges = {}
    for seed, rows in ((1.0, base), (0.0, loose)):
        for k, _, _, v, p in (x for own in rows.values() for x in own):
            if p:
                edges[p, k, v] = max(seed, edges.get((p, k, v), 0.0))
    size, seeds = {}, {}
    for (p, _, _), seed in edges.items():
        size[p], seeds[p] = size.get(p, 0) + 1, seeds.get(p, 0) + seed
    edges = {x: seed for x, seed in edges.items() if size[x[0]] >= pii.LEAST_INSTANCES and seeds[x[0]] > 0}
    beliefs, patterns = {}, {}
    for _ in range(pii.ROUNDS):
        total = {}
        for (p, k, v), seed in edges.items():
            if k >= 0:
                total[p, k] = total.get((p, k), 0.0) + max(seed, beliefs.get((v, k), 0.0))
        patterns = {x: t / (size[x[0]] + 1) for x, t in total.items() if t / (size[x[0]] + 1) >= pii.PATTERN_SCORE}
        doubt = {}
        for (p, k, v), seed in edges.items():
            if seed == 0 and (p, k) in patterns:
                doubt[v, k] = doubt.get((v, k), 1.0) * max(1 - patterns[p, k], 1e-12)
        beliefs = {x: 1 - d for x, d in doubt.items() if 1 - d >= pii.INSTANCE_BELIEF}
    out = {}
    for i in texts:
        own = [x[:3] for x in base[i]] + [x[:3] for x in loose[i] if (x[4], x[0]) in patterns and (x[3], x[0]) in beliefs]
        out[i] = ",".join(f"{kinds[k]}:{s}:{e}" for k, s, e in sorted(own))
    return out


def test_all_spans_against_plain_loops(spark):
    rows = {i: f"blah {i % 7}x please call me +1 (555) 010-{1000 + i} today, mail a{i}@b.cc or ip 10.0.0.{i}" for i in range(40)}
    rows |= {100: "so please call me 555-010-4242, today", 101: "room 555-010-4243 is clean 10.0.0", 102: "call me 12 mail x@y or ip 10.0.0.1:80 x", 103: "4111 1111 1111 1111x 9@8.7", 104: None}
    sf = {1000 + r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    for texts in (rows, rows | dict(enumerate(ODD, 500)), sf):
        want = brute_spans(texts)
        got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
        assert got == want
    assert "phone:18:30" in brute_spans(rows)[100]


def test_a_long_text_of_numbers_takes_linear_time(spark):
    import time

    text = lambda n: " ".join(f"a{i} {i}" for i in range(n))
    took = []
    for n in (2_000, 2_000, 60_000):  # about 0.9 MB
        df = spark.createDataFrame([(1, text(n))], "doc_id long, text string")
        begin = time.monotonic()
        assert pii.scan(df).selectExpr("size(loose) AS n").first().n == 2 * n
        took.append(time.monotonic() - begin)
    assert took[2] < 60 * max(took[1], 0.5)
    print(took)
