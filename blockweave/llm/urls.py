"""URL filter: host rules, and a weighted vocabulary counted by an Aho-Corasick automaton."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER

#: (verdict, host, path without its first slash).
RULES = (("block", "com", "en/"), ("allow", "example.com", "en/7"), ("allow", "net", "de/"), ("block", "example.net", "de/8"), ("block", "org", "es/"))
#: Weight 2 is strict: one hit rejects. Weight 1 is soft: that many distinct hits reject as LIMIT says.
VOCABULARY = {
    "porn": 2, "xxx": 2, "casino": 2, "viagra": 2, "cialis": 2, "escort": 2, "pills": 2, "spam": 2, "bets": 2, "betting": 2, "ads": 2, "malware": 2, "phishing": 2, "warez": 2,
    "cheap": 1, "free": 1, "win": 1, "track": 1, "farm": 1, "bonus": 1, "deal": 1, "click": 1, "adult": 1, "dating": 1, "loan": 1, "promo": 1, "poker": 1, "slots": 1, "torrent": 1, "crack": 1,
}
STRICT, LIMIT = 2, 2
_HOST = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_WORD = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): after the first ``://`` up to ``/ ? #``, A-Z lower-cased; then up to ``? #``. Else both empty."""
    m = _HOST.search(url) if url else None
    return (m[1].encode("utf-8", "surrogatepass").translate(ASCII_LOWER).decode("utf-8", "surrogatepass"), m[2]) if m else ("", "")


def rule_table(rules: tuple[tuple[str, str, str], ...]) -> dict[str, list[tuple[str, str, str]]]:
    """Rules by host, the longest path first."""
    by: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, host, path in rules:
        by.setdefault(host, []).append((path, f"{host}/{path}", verdict))
    for own in by.values():
        own.sort(key=lambda r: -len(r[0]))
    return by


def match_rule(host: str, path: str, rules: dict[str, list[tuple[str, str, str]]]) -> tuple[str | None, str | None]:
    """(rule, verdict) of the longest rule that fits the host or a parent domain and begins the path."""
    best: tuple[str | None, str | None] = (None, None)
    labels = host.split(".")
    for i in range(len(labels)):
        for own, rule, verdict in rules.get(".".join(labels[i:]), ()):
            if path.startswith(f"/{own}") and (best[0] is None or len(rule) > len(best[0])):
                best = (rule, verdict)
    return best


class Vocabulary:
    """Distinct strict and soft terms of a lower-cased URL that stand between other characters than a-z and 0-9."""

    def __init__(self, terms: dict[str, int]) -> None:
        self.automaton = ahocorasick.Automaton()
        for t, w in terms.items():
            if t:
                self.automaton.add_word(t, (t, w))
        self.empty = len(self.automaton) == 0
        if not self.empty:
            self.automaton.make_automaton()

    def hits(self, url: str | None) -> tuple[list[str], list[str]]:
        if not url or self.empty:
            return [], []
        low = url.encode("utf-8", "surrogatepass").translate(ASCII_LOWER).decode("latin-1")
        strict, soft = set(), set()
        for end, (t, w) in self.automaton.iter(low):
            s = end - len(t)
            if (s < 0 or ord(low[s]) not in _WORD) and (end + 1 == len(low) or ord(low[end + 1]) not in _WORD):
                (strict if w >= STRICT else soft).add(t)
        return sorted(strict), sorted(soft)


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, vocabulary: dict[str, int] | None = None, limit: int = LIMIT) -> DataFrame:
    """``(page_id, host, path, rule, verdict, strict, soft)``, a row for each row of ``pages(page_id, url)``.

    A rule decides if one fits (the longest). Else the page is blocked on one strict term or ``limit`` distinct
    soft ones. One pass over the url column, no shuffle. A null url, or one without ``://``, has an empty host
    and path, fits no rule and is judged by its terms; repeated rows stay; no rows give no rows.
    """
    by, terms = rule_table(rules), dict(VOCABULARY if vocabulary is None else vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary(terms)
        for b in batches:
            rows = []
            for u in b.column(1).to_pylist():
                host, path = split_url(u)
                rule, verdict = match_rule(host, path, by)
                strict, soft = words.hits(u)
                rows.append((host, path, rule, verdict or ("block" if strict or len(soft) >= limit else "allow"), len(strict), len(soft)))
            host, path, rule, verdict, strict, soft = map(list, zip(*rows)) if rows else ([],) * 6
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(x, pa.string()) for x in (host, path, rule, verdict)), pa.array(strict, pa.int32()), pa.array(soft, pa.int32())],
                ["page_id", "host", "path", "rule", "verdict", "strict", "soft"],
            )

    out = "page_id long, host string, path string, rule string, verdict string, strict int, soft int"
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string")).mapInArrow(run, out)


def sql(rules: tuple[tuple[str, str, str], ...] = RULES, vocabulary: dict[str, int] | None = None, limit: int = LIMIT, table: str = "pages") -> str:
    """The same in SQL, term by term."""
    terms = VOCABULARY if vocabulary is None else vocabulary
    hit = lambda t: f"cast(regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') as int)"
    total = lambda strict: " + ".join(hit(t) for t, w in terms.items() if (w >= STRICT) == strict) or "0"
    by_length = sorted(rules, key=lambda r: -len(f"{r[1]}/{r[2]}"))
    fits = lambda r: f"(host = '{r[1]}' or ends_with(host, '.{r[1]}')) and starts_with(path, '/{r[2]}')"
    case = lambda f: "case " + " ".join(f"when {fits(r)} then '{f(r)}'" for r in by_length) + " end"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
with cut as (
  select page_id, coalesce(translate(url, '{upper}', '{lower}'), '') as low,
    case when contains(url, '://') then substr(url, instr(url, '://') + 3) end as rest from {table}),
parts as (
  select page_id, low, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{lower}'), '') as host,
    coalesce(regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1), '') as path from cut),
counted as (select *, {total(True)} as strict, {total(False)} as soft, {case(lambda r: f"{r[1]}/{r[2]}")} as rule, {case(lambda r: r[0])} as ruled from parts)
select page_id, host, path, rule, coalesce(ruled, case when strict >= 1 or soft >= {limit} then 'block' else 'allow' end) as verdict,
  cast(strict as int) as strict, cast(soft as int) as soft from counted"""
