import re

from tidegauge.llm import mixing, secret_ledger


def shares(sizes, weights=(1, 2, 3), most=3):
    """Targets by repeated resharing, as the contract words it."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, full = float(sum(sizes.values())), {}
    while True:
        open_ = [s for s in names if s not in full]
        unit = left / sum(w[s] for s in open_) if open_ else 0
        over = [s for s in open_ if unit * w[s] > most * sizes[s] + 1e-9]
        if not over:
            return {**full, **{s: unit * w[s] for s in open_}}
        for s in over:
            full[s] = most * sizes[s]
            left -= full[s]


def test_mix_brute_force(spark):
    rows = [(i, "w " * (i % 37 + 1), f"s{i % 3}" if i % 11 else None) for i in range(300)]
    rows += [(900, None, "s0"), (901, "", "tiny"), (902, "one word\ttwo", "tiny"), (903, "a b", "tiny"), (903, "a b", "tiny"), (None, "n u l l", "s1")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size int, _key int")
    out = mixing.mix(df.repartition(7), carry=["source"]).collect()
    again = mixing.mix(df.repartition(3), carry=["source"]).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = shares(size)
    assert len(out) == len(rows) and set(want) >= {None, "tiny"}
    assert any(abs(want[s] - 3 * size[s]) < 1e-9 for s in want)  # a capped source
    taken = {}
    for r in out:
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and r["source_size"] == size[r["source"]]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - t) < 1 + 1e-6 for s, t in want.items())


def test_mix_empty_and_blank(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    out = mixing.mix(spark.createDataFrame([(1, None, None), (2, "", "a")], schema)).collect()
    assert [(r["size"], r["taken"], r["target"]) for r in out] == [(0, 0, 0.0)] * 2


def spans_of(text):
    out = []
    for nth, rule in enumerate(secret_ledger.RULES):
        pattern = re.compile(rule.pattern, re.ASCII)
        for m in pattern.finditer(text):
            if len(m.group(2 if pattern.groups >= 2 else 0)) >= rule.least:
                out.append((m.start(), nth, rule.kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(out)]


TEXTS = [
    "password=abc secret: token: abcdefg", "é🙂 API_KEY = \"0123456789abcdef0123456789\" x", "AKIA" + "Z" * 15 + " AKIA" + "9" * 16, "AKIAAKIA" * 4, "f" * 24 + "g" + "a" * 23,
    "ghp_" + "a1" * 20, "-----BEGIN RSA PRIVATE KEY-----", "", None, "secret=token=abcdef", "x" * 300_000 + " token:abcdef1",
]


def test_findings_brute_force_and_ledger(spark):
    rows = [(i, t, "k") for i, t in enumerate(TEXTS)] + [(50, TEXTS[1], "k"), (50, TEXTS[1], "k"), (None, TEXTS[0], "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, blob string")
    found, ledger = secret_ledger.scan(df)
    got = sorted((str(r["path"]), [(s["kind"], s["start"], s["end"]) for s in r["spans"]]) for r in found.collect())
    assert got == sorted((str(i), spans_of(t or "")) for i, t, _ in rows)
    blobs = len({t or "" for t in TEXTS})
    assert ledger.count() >= blobs * len(secret_ledger.RULES)
    # a second run scans only what is new: one unseen text, one new rule version
    later = df.unionByName(spark.createDataFrame([(99, "token = 'zzzzzzzz'", "k")], df.schema))
    assert secret_ledger.scan_new(df, ledger).count() == 0
    assert secret_ledger.scan_new(later, ledger).count() == len(secret_ledger.RULES)
    newer = [*secret_ledger.RULES[:-1], secret_ledger.RULES[-1]._replace(version=2)]
    assert {(r["kind"], r["version"]) for r in secret_ledger.scan_new(df, ledger, newer).collect()} == {("webtoken", 2)}
    assert secret_ledger.scan(df.limit(0))[0].count() == 0


def test_redact(spark):
    df = spark.createDataFrame([(1, "a password=abcdef z", 19, 7), (2, None, 0, 8), (3, "é " + "a" * 30 + " é token:" + "b" * 30, 71, 9)], "doc_id long, text string, n_chars long, spans int")
    found, _ = secret_ledger.scan(df.select("doc_id", "text"))
    out = {r["doc_id"]: r for r in secret_ledger.redact(df.drop("spans"), found).collect()}
    assert out[1]["text"] == "a [SECRET] z" and out[1]["n_chars"] == 12
    assert out[2]["text"] is None
    assert out[3]["text"] == "é [SECRET] é [SECRET]"
