import re

import duckdb

from blockweave.llm import licenses

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = [
    None, "", "mit", "MIT License", "mit license mit license. The MIT\nLicense!", "mit x license", "apache license and General  Public-License", "gnu general public public license",
    "Licensed under CC BY-NC 4.0.", "permission is hereby granted, free of charge, to any person obtaining a copy of this fine software and associated documentation files", "of the to the of the is of the",
    "é mit license é", "general public license " * 50, "Kit mİt license", "x " * 30000 + "apache license",
]


def base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    hits = [(i, lab) for p, lab in licenses.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in hits]
    return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({lab for _, lab in hits}))


def test_phrases_against_every_place(spark):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "en", "s", 0), (None, TEXTS[4], "en", "s", 0)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as pos", "'x' as gram", "2 as t")
    out = licenses.scan(df).collect()
    assert sorted((tuple(r)[:6] for r in out), key=repr) == sorted(((r[0], *base(r[1])) for r in rows), key=repr)
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    assert by[8].labels == "cc-by-nc" and by[9].labels == "mit" and by[9].n_base == 0 and 0.7 <= by[9].score < 1
    assert by[10].labels == "" and by[10].score == 0 and by[6].labels == "apache,gpl" and by[6].score == 1
    duckdb.sql("create or replace temp table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    duckdb.executemany("insert into documents values (?, ?, ?, ?, ?)", rows)
    assert sorted(duckdb.sql(licenses.sql()).fetchall(), key=repr) == sorted(map(tuple, out), key=repr)


def aligned(words, text, gap=3, drift=9):
    """The share of a notice's informative pairs that stand in order in one span of a document, straight from the definition."""
    t = text.split()
    grams = [(i, p) for i, p in enumerate(zip(t, t[1:])) if not set(p) <= licenses.COMMON]
    hits = [(pos - i, i, pos) for pos, p in enumerate(zip(words, words[1:])) for i, g in grams if p == g]
    best, diagonals = 0.0, sorted({h[0] for h in hits})
    spans = [[d for d in diagonals if d in own] for own in _runs(diagonals, gap)]
    for own in spans:
        votes = {d: sum(h[0] == d for h in hits) for d in own}
        top = min(own, key=lambda d: (-votes[d], d))
        first = {}
        for d, i, pos in hits:
            if d in own and abs(d - top) <= drift:
                first[i] = min(first.get(i, pos), pos)
        order = [first[i] for i in sorted(first)]
        best = max(best, sum(p > q for p, q in zip(order, [-1, *order])) / len(grams))
    return best


def _runs(values, gap):
    out = []
    for v in values:
        if out and v - max(out[-1]) <= gap:
            out[-1].add(v)
        else:
            out.append({v})
    return out


NOTICE = licenses.NOTICES[0][0]
REPEATS = [
    "licensed under " * 8, "public license " * 30, "redistribution and use " * 20, "licensed under " * 8 + "cc by nc 4 0 end", f"{NOTICE} " * 3, " ".join(reversed(NOTICE.split())),
    NOTICE.replace("free of charge", "free, without any charge at all, of charge"), " ".join(NOTICE.split()[:10]), f"x {NOTICE} y {licenses.NOTICES[4][0]}", "of charge free of charge to any person " * 4, f"public license {licenses.NOTICES[3][0]}",
]


def test_repeated_pairs_are_no_notice(spark):
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(REPEATS)], SCHEMA)
    out = licenses.scan(df).collect()
    by = {r.doc_id: r for r in out}
    assert all(by[i].labels == "" and by[i].score == 0 for i in (0, 1, 2, 5, 7, 9))
    assert by[3].labels == "cc-by-nc" and by[4].labels == by[6].labels == "mit" and set(by[8].labels.split(",")) >= {"mit", "gpl"}
    for i, t in enumerate(REPEATS):
        words, want = re.findall("[a-z0-9]+", t.lower()), set(base(t)[4].split(",")) - {""}
        shares = [(aligned(words, n), lab) for n, lab in licenses.NOTICES]
        assert set(by[i].labels.split(",")) - {""} == want | {lab for s, lab in shares if s >= 0.7}
        assert by[i].score == max([round(s, 9) for s, _ in shares if s >= 0.7] + [1.0 if want else 0.0])
    duckdb.sql("create or replace temp table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    duckdb.executemany("insert into documents values (?, ?, 'en', 's', 0)", [list(x) for x in enumerate(REPEATS)])
    assert sorted(duckdb.sql(licenses.sql()).fetchall(), key=repr) == sorted(map(tuple, out), key=repr)


def test_empty(spark):
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).count() == 0
