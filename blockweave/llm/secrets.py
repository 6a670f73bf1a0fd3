"""Secret scan: candidates by pattern, false positives removed by a random forest; DataFrame operations only."""

from __future__ import annotations

import random
import string
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Long runs of key characters with a digit, and shorter values right after a telling name; behind its "=" the value is whole.
CANDIDATE = (
    r"(?<![A-Za-z0-9+/_\-])(?:(?<!=)|(?<!(?i:passw(?:or)?d|pwd|secret|token|key)[\"']{0,1}[ ]{0,1}[=:]{0,1}=))(?=[A-Za-z+/_\-]*+[0-9])[A-Za-z0-9+/_\-]{16,}+={0,2}"
    r"|(?:(?<=[=:\"'])|(?<=[=:] ))(?<=(?i:passw(?:or)?d|pwd|secret|token|key)[\"']{0,1}[ ]{0,1}[=:]{1,2}[ ]{0,1}[\"']{0,1})(?![ \"'])[^\s\"',;<>]{8,}+"
)
#: A text without a digit, "=" or ":" holds no candidate; finding that out costs a fraction of the search.
POSSIBLE = "[0-9=:]"
#: English words of four letters and more whose cover speaks against chance.
DICTIONARY = tuple(
    "about account address after again amount application array article background bank base before begin block body book border bottom button call card case center change channel character check child class click client close code color column comment common component config connect console content context control copy count country create current customer data date debug default delete describe description design detail device dialog different direct display document domain down download drop edit element email enable encode error event example export field file filter find first fixed font footer form format from function general generate global group handler hash head header height help hidden history home host html http icon image import index info initial inner input insert instance integer internal item john language large last layout left length level library license light line link list load local lock login logo long look loop main make manager margin master match menu message method mode model module month more move name native network next node none normal note null number object offset only open option order other output package page panel param parent part password path people percent phone photo picture place point popup position post prefix preview price primary print process product profile project property public query random range read record reference register release remove render replace report request require reset resource response result return right role root round rule sample save scale schema scope screen script scroll search section select self send serial server service session setting share shell show side sign simple single site size slide small sort source space split stack start state static status step stop store stream string style submit success support switch system table target task team template test text thank their theme then there thing this time title today toggle token tool track type unit update upload user util valid value variable version video view visible want when where which white width window with word work world write year your zone".split()
)
FEATURES = {
    "length": "cast(length(v) as double)",
    "digits": "length(regexp_replace(v, '[^0-9]', '')) / length(v)",
    "capitals": "length(regexp_replace(v, '[^A-Z]', '')) / length(v)",
    "class_changes": "regexp_count(v, '(?<=[a-z])(?=[0-9A-Z])|(?<=[A-Z])(?=[0-9])|(?<=[0-9])(?=[a-zA-Z])') / greatest(1, length(v) - 1)",
    "common_pairs": "regexp_count(lower(v), '(?=th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|hi|ri|ro|ic|ne|ea|ra|ce)') / greatest(1, length(v) - 1)",
    "vowels": "regexp_count(lower(v), '[aeiou]') / greatest(1, length(regexp_replace(v, '[^A-Za-z]', '')))",
    "distinct": "size(array_distinct(split(v, ''))) / length(v)",
    "dictionary": f"1 - length(regexp_replace(lower(v), '{'|'.join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))}', '')) / length(v)",
    "hex": "if(v rlike '^[0-9a-fA-F]+$', 1D, 0D)",
    "number": "if(v rlike '^[0-9_./+-]+$', 1D, 0D)",
    "uuid": "if(v rlike '[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}', 1D, 0D)",
    "breaks": "regexp_count(v, '[/_-]') / length(v)",
    "known_prefix": "if(v rlike '^(AKIA|ASIA|AIza|ghp_|gho_|github_pat_|glpat-|xox[abprs]-|sk_live_|rk_live_|sk-|eyJ)', 1D, 0D)",
    "name_before": "if(b rlike '(?i)(passw(or)?d|pwd|secret|token|key|auth|bearer|credential)[^a-z0-9]{0,8}$', 1D, 0D)",
    "placeholder": "if(concat(v, ' ', b) rlike '(?i)(example|sample|dummy|placeholder|change_?me|your|xxxx|redacted|fake|test)', 1D, 0D)",
    "digest_near": "if(concat(b, ' ', a) rlike '(?i)(sha-?[0-9]*|md5|commit|checksum|digest|integrity|etag|revision|guid|uuid|base64|https?:|href|src=|card|order|isbn)', 1D, 0D)",
    "path": "if(p rlike '(?i)(test|example|fixture|mock|docs?/|node_modules|\\\\.lock|\\\\.min\\\\.|vendor)', 1D, 0D)",
}
#: Pairs of characters that may mark candidates; texts hardly hold the first pair and never all.
MARKS = (("\u0001", "\u0002"), *((chr(c), chr(c + 1)) for c in range(0xFDD0, 0xFDF0, 2)))
#: So many candidates are summed at a time, so that work grows with their number, not with its square.
STRIDE = 128


def labelled_findings(n: int = 3000, seed: int = 3) -> list[tuple[str, str, str, str, int]]:
    """(value, text before, text after, path, 1 if a secret): made-up findings of the kinds that scanners dispute.

    They stand in for a reviewer's file of labelled findings, which ``train`` takes in the same form.
    """
    r = random.Random(seed)
    any_of = lambda chars, k: "".join(r.choices(chars, k=k))
    hexa, base = "0123456789abcdef", string.ascii_letters + string.digits
    words = [w for w in DICTIONARY]
    prose = lambda k: " ".join(r.choices(words, k=k))
    name = lambda: r.choice(["password", "passwd", "pwd", "token", "secret", "api_key", "access_key", "auth_token", "client_secret", "SECRET_KEY", "key"]) + r.choice(["=", " = ", ": ", '="', ' = "', ": '", '": "'])
    paths = ["", "src3", "app/main.py", "deploy/prod.env", "conf/settings.yml", "lib/client.js"]
    quiet = [*paths, "tests/test_api.py", "docs/guide.md", "examples/demo.py", "fixtures/keys.json", "package.lock", "dist/app.min.js"]
    out = []
    for _ in range(n // 2):
        kind, before = r.randrange(7), f"{prose(4)} "
        v = (
            "AKIA" + any_of(string.ascii_uppercase + "234567" + string.digits, 16) if kind < 2 else any_of(hexa, r.choice([24, 32, 40, 40, 64])) if kind == 2
            else any_of(base, r.randint(20, 64)) if kind == 3 else r.choice(["ghp_", "sk_live_", "glpat-", "xoxb-", "AIza"]) + any_of(base, 36)
            if kind == 4 else any_of(base + "!@#$%^&*", r.randint(9, 16)) if kind == 5 else any_of(hexa, 40)
        )
        if kind in (2, 3, 5, 6) or r.random() < 0.3:
            before += name()
        out.append((v, before[-48:], r.choice(['" ', "' ", " ", "\n"]) + prose(3), r.choice(paths), 1))
    for _ in range(n - n // 2):
        kind, before, h = r.randrange(10), f"{prose(4)} ", any_of(hexa, 32)
        if kind == 0:
            v, before = any_of(hexa, r.choice([32, 40, 64])), before + r.choice(["commit ", "sha256:", "md5 ", "checksum ", "digest: ", "integrity ", "etag "])
        elif kind == 1:
            v, before = f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}", before + r.choice(["", "id=", "uuid ", "guid: "])
        elif kind == 2:
            v = any_of(string.digits, r.choice([16, 16, 18, 20]))
        elif kind == 3:
            v, before = r.choice(["YOUR_TOKEN_HERE_1", "xxxxxxxxxxxxxxx1", "changeme123456789", "example-password-1", "test_password_123", "<redacted-2024>", "dummy_secret_key_0"]), before + name()
        elif kind == 4:
            v = "".join(w.title() for w in r.choices(words, k=4)) + str(r.randint(1, 99))
        elif kind == 5:
            v = r.choice("/_-").join(r.choices(words, k=4)) + f"-{r.randint(1, 2030)}"
        elif kind == 6:
            v, before = any_of(base + "+/", r.randint(40, 120)), before + r.choice(["data:image/png;base64,", "src=", "https://cdn/"])
        elif kind == 7:
            v, before = r.choice(["get", "self.", "os.environ_", "config_"]) + "_".join(r.choices(words, k=2)) + str(r.randint(0, 9)), before + name()
        elif kind == 8:
            v = any_of(hexa, r.choice([16, 24, 32, 40]))
        else:
            v, before = f"{any_of(string.ascii_lowercase, 4)}-{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}-{r.choice(words)}", before
        out.append((v, before[-48:], r.choice([" ", ". ", '" ', "\n"]) + prose(3), r.choice(quiet), 0))
    return out


@dataclass
class Tree:
    feature: int = -1
    cut: float = 0.0
    share: float = 0.0
    low: Tree | None = None
    high: Tree | None = None

    def sql(self, names: list[str]) -> str:
        if self.low is None:
            return f"{self.share:.6f}D"
        return f"if(x.{names[self.feature]} <= {self.cut!r}D, {self.low.sql(names)}, {self.high.sql(names)})"

    def value(self, x) -> float:
        if self.low is None:
            return round(self.share, 6)
        return (self.low if x[self.feature] <= self.cut else self.high).value(x)


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, leaf: int = 5) -> Tree:
    """A tree by Gini impurity; each split looks at a random half of the features and sixteen cuts of each."""
    node = Tree(share=float(y.mean()))
    if depth == 0 or len(y) < 2 * leaf or y.min() == y.max():
        return node
    best = (2 * node.share * (1 - node.share) - 1e-9, -1, 0.0)
    for f in rng.permutation(x.shape[1])[: -(-x.shape[1] // 2)]:
        for cut in np.unique(np.quantile(x[:, f], np.linspace(0, 1, 17)[:-1], method="lower")):
            left = x[:, f] <= cut
            n = int(left.sum())
            if leaf <= n <= len(y) - leaf:
                a, b = y[left].mean(), y[~left].mean()
                gini = (n * 2 * a * (1 - a) + (len(y) - n) * 2 * b * (1 - b)) / len(y)
                if gini < best[0]:
                    best = (gini, int(f), float(cut))
    if best[1] < 0:
        return node
    left = x[:, best[1]] <= best[2]
    node.feature, node.cut = best[1], best[2]
    node.low, node.high = grow(x[left], y[left], rng, depth - 1, leaf), grow(x[~left], y[~left], rng, depth - 1, leaf)
    return node


def features(spark: SparkSession, findings: list[tuple[str, str, str, str, int]]) -> tuple[np.ndarray, np.ndarray]:
    rows = spark.createDataFrame([(*f[:4], int(f[4])) for f in findings], "v string, b string, a string, p string, y int")
    got = rows.selectExpr(*[f"{e} as {n}" for n, e in FEATURES.items()], "y").collect()
    return np.array([[float(r[n]) for n in FEATURES] for r in got]).reshape(-1, len(FEATURES)), np.array([r.y for r in got], np.float64)


_trained: dict[tuple, list[Tree]] = {}


def train(spark: SparkSession, findings: list[tuple[str, str, str, str, int]] | None = None, trees: int = 16, depth: int = 6, seed: int = 1) -> list[Tree]:
    """A forest from labelled findings, whose number bounds the work; features come from the same SQL that scans."""
    key = (tuple(findings) if findings is not None else None, trees, depth, seed)
    if key not in _trained:
        x, y = features(spark, labelled_findings() if findings is None else findings)
        rng = np.random.default_rng(seed)
        _trained[key] = []
        for _ in range(trees if len(y) else 0):
            i = rng.integers(0, len(y), len(y))
            _trained[key].append(grow(x[i], y[i], rng, depth))
    return _trained[key]


def _found(docs: DataFrame, forest: list[Tree], threshold: float, keep: list[str]) -> DataFrame:
    """The columns in ``keep``, ``lead`` (text before the first candidate) and ``found``: candidates in order.

    The text is marked around each candidate and split at the marks, the first pair of ``MARKS`` of which the text holds
    neither. (A text that holds one of all 17 pairs loses the last pair's to spaces.)
    """
    t = "coalesce(cast(text as string), '')"
    free = lambda a, b: f"not contains(_t, {a}) and not contains(_t, {b})"
    lit = lambda k: f"named_struct('a', '{MARKS[k][0]}', 'b', '{MARKS[k][1]}')"
    others = f"get(filter(array({', '.join(map(lit, range(1, len(MARKS))))}), m -> {free('m.a', 'm.b')}), 0)"
    quoted = [f"'{m}'" for m in MARKS[0]]
    first = f"if({free(*quoted)}, {lit(0)}, {others})"
    rows = docs.selectExpr(*keep, f"{t} as _t", "coalesce(cast(source as string), '') as _p").withColumn("_m", F.expr(first))
    rows = rows.selectExpr(*keep, "_p", f"coalesce(_m, {lit(-1)}) as _m", f"if(_m is null, translate(_t, '{''.join(MARKS[-1])}', '  '), _t) as _t")
    q = CANDIDATE.replace("\\", "\\\\").replace("'", "\\'")
    rows = rows.selectExpr(*keep, "_p", "_m.b as _end", f"if(_t rlike '{POSSIBLE}', split(regexp_replace(_t, '({q})', concat(_m.a, '$1', _m.b)), _m.a), array(_t)) as _parts")
    cut = "transform(slice(_parts, 2, greatest(0, size(_parts) - 1)), s -> named_struct('v', substring_index(s, _end, 1), 'rest', substring(s, length(substring_index(s, _end, 1)) + 2)))"
    rows = rows.selectExpr(*keep, "_p", "_parts[0] as lead", f"{cut} as _cut")
    # the text before each candidate, and where it starts: sums by strides, then inside each stride
    rows = rows.selectExpr(
        *keep, "_p", "lead", "zip_with(_cut, slice(concat(array(lead), transform(_cut, c -> c.rest)), 1, size(_cut)), (c, t) -> named_struct('v', c.v, 'rest', c.rest, 'b', right(t, 48))) as _cut",
        f"transform(sequence(0, (size(_cut) - 1) div {STRIDE}), k -> transform(slice(_cut, k * {STRIDE} + 1, {STRIDE}), c -> length(c.v) + length(c.rest))) as _long",
    )
    sums = lambda items, first, step: f"aggregate({items}, named_struct('at', {first}, 'out', cast(array() as array<int>)), (s, c) -> named_struct('at', s.at + {step}, 'out', array_append(s.out, s.at))).out"
    rows = rows.selectExpr(*keep, "_p", "lead", "_cut", "_long", sums("_long", "length(lead)", "aggregate(c, 0, (n, x) -> n + x)") + " as _first")
    rows = rows.selectExpr(*keep, "_p", "lead", f"zip_with(_cut, flatten(zip_with(_long, _first, (own, f) -> {sums('own', 'f', 'c')})), (c, n) -> named_struct('v', c.v, 'rest', c.rest, 'start', n, 'b', c.b)) as _cut")
    names = list(FEATURES)
    import re

    own = lambda e: re.sub(r"(?<![\w'.\\])([vb])(?=[,) ])", r"c.\1", re.sub(r"\ba(?=\) rlike)", "left(c.rest, 48)", re.sub(r"\bp(?= rlike)", "_p", e)))
    struct = ", ".join(f"'{n}', {own(e)}" for n, e in FEATURES.items())
    votes = " + ".join(tree.sql(names) for tree in forest) or "0D"
    rows = rows.selectExpr(*keep, "lead", f"""transform(transform(_cut, c -> named_struct('v', c.v, 'rest', c.rest, 'start', c.start, {struct})),
        x -> named_struct('v', x.v, 'rest', x.rest, 'start', x.start, 'score', round(({votes}) / {max(1, len(forest))}, 6))) as found""")
    return rows.selectExpr(*keep, "lead", f"transform(found, x -> named_struct('v', x.v, 'rest', x.rest, 'start', x.start, 'score', x.score, 'secret', x.score >= {threshold}D)) as found")


def scan(docs: DataFrame, forest: list[Tree] | None = None, threshold: float = 0.5) -> DataFrame:
    """``(doc_id, start, length, value_md5, score, secret)``: a row for each candidate of each row of ``docs``.

    ``start`` counts characters from 0; the value itself isn't repeated, only its MD5. ``score`` is the forest's
    mean vote, ``secret`` whether it reaches ``threshold``. The path feature reads ``source``. One pass, no
    shuffle: candidates are found, described and judged inside the row. Null and empty texts give no rows,
    repeated rows give theirs again, a null doc_id stays; no rows give no rows; other columns are not read.
    """
    forest = train(docs.sparkSession) if forest is None else forest
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"))
    rows = _found(plain, forest, threshold, ["doc_id"])
    # inline_outer, for which the optimizer infers no filter: pushed below the projections it would find all candidates twice
    rows = rows.selectExpr("doc_id", "inline_outer(found)").where("v is not null")
    return rows.selectExpr("doc_id", "cast(start as long) as start", "cast(length(v) as long) as length", "md5(cast(v as binary)) as value_md5", "score", "secret")


def redact(docs: DataFrame, forest: list[Tree] | None = None, threshold: float = 0.5, put: str = "[SECRET]") -> DataFrame:
    """``docs`` with each secret replaced by ``put`` and n_chars, if there, the new length; rows and columns stay.

    Texts without a secret, null and empty ones among them, are as they were; repeated rows are redacted alike, a null
    doc_id or source changes nothing, clashing names of other columns don't matter; no rows give no rows.
    """
    forest = train(docs.sparkSession) if forest is None else forest
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    at = {c: names[docs.columns.index(c)] for c in ("text", "source")}
    rows = _found(plain.select("*", *[F.col(k).alias(c) for c, k in at.items()]), forest, threshold, names)
    clean = f"concat(lead, array_join(transform(found, x -> concat(if(x.secret, '{put}', x.v), x.rest)), ''))"
    rows = rows.withColumn("_hit", F.expr("exists(found, x -> x.secret)")).withColumn(at["text"], F.when(F.col("_hit"), F.expr(clean)).otherwise(F.col(at["text"])))
    if "n_chars" in docs.columns:
        n = names[docs.columns.index("n_chars")]
        rows = rows.withColumn(n, F.when(F.col("_hit"), F.length(at["text"]).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(n)))
    return rows.select(*[F.col(k).alias(c) for k, c in zip(names, docs.columns)])
