"""URL filter: host and path rules first, then a weighted vocabulary counted by Aho-Corasick.

The longest rule whose host equals the url's host or one of its parent domains, and whose path starts the
url's path, decides. Where none fits, the vocabulary does: a url is blocked by one strict term, or by SOFT_LIMIT
distinct soft terms whose weights (twice as much in the host) sum to SOFT_WEIGHT. A term counts only between boundaries
(no ASCII letter or digit beside it). The vocabulary here is a small list of this repository's own, of words that
stand in hosts and paths of adult, gambling and spam sites; vocabulary() makes one of any table of terms.

Edge cases. A null url, or one without "://", has an empty host and path, fits no rule and is judged by the
vocabulary (null: allow). Repeated rows are judged each for themselves; an empty table gives an empty
result; other columns are ignored. Whole urls are scanned, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched

#: The rules (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: The strict terms, and the soft ones by weight (3: rare elsewhere, 1: common in clean urls too).
STRICT = (
    "camgirls", "casino", "erotica", "escort", "escorts", "gambling", "hentai", "keygen", "milf", "phishing", "porn", "porno",
    "sexcam", "spam", "spyware", "viagra", "cialis", "warez", "webcamsex", "xxx",
)
SOFT_BY_WEIGHT = {
    3: ("blackjack", "bingo", "jackpot", "nude", "pills", "poker", "roulette", "sportsbook", "torrent", "torrents"),
    2: ("adult", "bet", "bets", "betting", "cracked", "dating", "loan", "loans", "lottery", "nulled", "payday", "prize", "serial", "sex", "slots"),
    1: ("ads", "bonus", "cheap", "click", "coupon", "deal", "deals", "discount", "farm", "free", "hot", "promo", "track", "win", "winner"),
}
SOFT = {term: weight for weight, terms in SOFT_BY_WEIGHT.items() for term in terms}
#: Parameters: distinct soft terms and their least weight that block; terms of a vocabulary at most.
SOFT_LIMIT, SOFT_WEIGHT = 2, 4
MOST_TERMS = 1_000_000

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "page_id long, host string, path string, rule string, verdict string, n_strict int, n_soft int, soft_weight int"


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    tail = rest[end:]
    stop = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return rest[:end].translate(LOWER), tail[:stop]


class Rules:
    """Rules by host; the longest that fits wins (ties: the one listed first)."""

    def __init__(self, rules: Sequence[tuple[str, str, str]]):
        self.by_host: dict[str, list] = {}
        for verdict, host, path in rules:
            self.by_host.setdefault(host, []).append((path, host + path, verdict))

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        best, at = None, 0
        while True:
            for start, name, verdict in self.by_host.get(host[at:], ()):
                if path.startswith(start) and (best is None or len(name) > len(best[0])):
                    best = name, verdict
            at = host.find(".", at) + 1
            if not at:
                return best


@lru_cache
def automaton(strict: tuple[str, ...], soft: tuple[str, ...]):
    found = ahocorasick.Automaton()
    for kind, terms in enumerate((soft, strict)):
        for t in terms:
            found.add_word(t, (t, kind))
    found.make_automaton()
    return found


def plain(char: str) -> bool:
    return char.isascii() and char.isalnum()


def terms_in(text: str, strict: tuple[str, ...], soft: tuple[str, ...]) -> tuple[set[str], set[str]]:
    """Distinct soft and strict terms that stand between boundaries."""
    hits: tuple[set[str], set[str]] = (set(), set())
    if len(text) > 1 and (strict or soft):
        for end, (term, kind) in automaton(strict, soft).iter(text):
            start = end + 1 - len(term)
            if not (start and plain(text[start - 1])) and not (end + 1 < len(text) and plain(text[end + 1])):
                hits[kind].add(term)
    return hits


def vocabulary_hits(url: str | None, host: str, strict: tuple[str, ...], soft: dict[str, int]) -> tuple[int, int, int]:
    """Numbers of distinct strict and soft terms, and the soft ones' weight (twice for those in the host)."""
    mild, hard = terms_in((url or "").translate(LOWER), strict, tuple(soft))
    loud = terms_in(host, (), tuple(soft))[0] if mild else set()
    return len(hard), len(mild), sum(soft[t] * (1 + (t in loud)) for t in mild)


def vocabulary(terms: DataFrame) -> tuple[tuple[str, ...], dict[str, int]]:
    """(strict, soft) of a table (term, weight, strict): lower-case ASCII terms, MOST_TERMS at most, else ValueError."""
    got = terms.select("term", "weight", "strict").distinct().limit(MOST_TERMS + 1).collect()
    if len(got) > MOST_TERMS or not all(r.term and r.term.isascii() and r.term == r.term.lower() and r.term.isalnum() for r in got):
        raise ValueError(f"a vocabulary takes up to {MOST_TERMS} terms of lower-case ASCII letters and digits")
    return tuple(sorted({r.term for r in got if r.strict})), {r.term: int(r.weight) for r in sorted(got) if not r.strict}


def url_verdicts(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, strict: tuple[str, ...] = STRICT, soft: dict[str, int] = SOFT, soft_limit: int = SOFT_LIMIT, soft_weight: int = SOFT_WEIGHT) -> DataFrame:
    """page_id, host, path, rule, verdict, n_strict, n_soft and soft_weight for every row."""
    batched(df.sparkSession)
    kinds = [pa.string()] * 4 + [pa.int32()] * 3

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Rules(rules)
        for b in batches:
            out = []
            for url in b.column(1).to_pylist():
                host, path = parts(url)
                hard, mild, weight = vocabulary_hits(url, host, strict, soft)
                blocked = hard > 0 or mild >= soft_limit and weight >= soft_weight
                rule, verdict = table.match(host, path) or (None, "block" if blocked else "allow")
                out.append((host, path, rule, verdict, hard, mild, weight))
            cols = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return df.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url")).mapInArrow(judge, SCHEMA)


def oracle() -> str:
    """The same verdicts as DuckDB SQL over pages."""
    host = "translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = "regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's')"
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    pick = lambda what: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h + p if what == 'rule' else v}'" for v, h, p in ordered)
    stands = lambda t, where: f"CAST(regexp_matches({where}, '(^|[^a-z0-9]){t}($|[^a-z0-9])') AS INTEGER)"
    count = lambda terms: " + ".join(stands(t, "low") for t in terms)
    weight = " + ".join(f"{w} * ({stands(t, 'low')} + {stands(t, 'host')})" for t, w in SOFT.items())
    return f"""
WITH p AS (SELECT page_id, coalesce({host}, '') AS host, coalesce({path}, '') AS path,
  coalesce(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS low FROM pages),
h AS (SELECT *, CAST({count(STRICT)} AS INTEGER) AS n_strict, CAST({count(SOFT)} AS INTEGER) AS n_soft, CAST({weight} AS INTEGER) AS soft_weight FROM p)
SELECT page_id, host, path, {pick("rule")} END AS rule,
  {pick("verdict")} ELSE CASE WHEN n_strict >= 1 OR n_soft >= {SOFT_LIMIT} AND soft_weight >= {SOFT_WEIGHT} THEN 'block' ELSE 'allow' END END AS verdict, n_strict, n_soft, soft_weight
FROM h"""
