"""URL rules by a Bloom filter cascade: exact membership without joins.

The key universe is complete: every (host suffix, path prefix) of the corpus's URLs that
could be a rule. Level 0 encodes the listed keys; level 1 encodes the keys of the universe
that level 0 passes though they are not listed; level 2 the listed keys that level 1 passes;
and so on, until nothing is passed by mistake. A key's answer is the parity of the first
level that rejects it, and it is exact for every key of the universe.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freed

Rule = tuple[str, str, str]  # verdict, host, path
#: The rules of the query.
RULES: list[Rule] = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
_LOWER = {c: c + 32 for c in range(65, 91)}


class Bloom:
    def __init__(self, keys: Iterable[str], rate: float, salt: int):
        keys = list(keys)
        self.salt, self.k = salt, max(1, round(-math.log2(rate)))
        self.m = max(64, math.ceil(-len(keys) * math.log(rate) / math.log(2) ** 2))
        bits = np.zeros(self.m + 7 >> 3, np.uint8)
        for key in keys:
            for at in self._places(key):
                bits[at >> 3] |= 1 << (at & 7)
        self.bits = bits.tobytes()

    def _places(self, key: str) -> list[int]:
        h = xxhash.xxh3_128_intdigest(key.encode("utf-8", "surrogatepass"), self.salt)
        a, b = h >> 64, h & 0xFFFFFFFFFFFFFFFF | 1
        return [(a + i * b) % self.m for i in range(self.k)]

    def __contains__(self, key: str) -> bool:
        bits = self.bits
        return all(bits[at >> 3] >> (at & 7) & 1 for at in self._places(key))


class Cascade:
    """levels[0] holds the listed keys, levels[1] what it passes by mistake, and so on."""

    def __init__(self, first: Bloom, listed: set[str], mistaken: set[str]):
        self.levels, inside, outside = [first], listed, mistaken
        while outside:
            level = Bloom(outside, 0.25, len(self.levels))
            self.levels.append(level)
            inside, outside = outside, {k for k in inside if k in level}

    def __contains__(self, key: str) -> bool:
        for i, level in enumerate(self.levels):
            if key not in level:
                return i % 2 == 1
        return len(self.levels) % 2 == 1


def parts(url: str | None) -> tuple[str, str]:
    """Host and path of a URL; both empty for null and for URLs without ://."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min([i for c in "/?#" if (i := rest.find(c)) >= 0], default=len(rest))
    tail = rest[end:]
    stop = min([i for c in "?#" if (i := tail.find(c)) >= 0], default=len(tail))
    return rest[:end].translate(_LOWER), tail[:stop]


def _key(host: str, path: str) -> str:
    return host + "\0" + path


class Judge:
    """Candidate keys of a URL, longest first, limited to host depths and path lengths that rules have."""

    def __init__(self, rules: list[Rule]):
        self.depths = sorted({host.count(".") + 1 for _, host, _ in rules}, reverse=True)
        self.lengths = sorted({len(path) for *_, path in rules}, reverse=True)

    def candidates(self, host: str, path: str) -> list[tuple[str, str]]:
        labels = host.split(".")
        hosts = [".".join(labels[-n:]) for n in self.depths if n <= len(labels)]
        found = [(h, path[:n]) for h in hosts for n in self.lengths if n <= len(path)]
        return sorted(found, key=lambda x: (-len(x[0]) - len(x[1]), -len(x[0])))


def fit(urls: DataFrame, rules: list[Rule], url_col: str = "url") -> tuple[Judge, dict[str, Cascade]]:
    """A cascade for each verdict, over all keys of the URLs' universe.

    Level 0's rate follows the size of the universe, so the mistaken keys that the driver
    gathers are about as many as the listed ones; if there are many more, the rate is
    lowered and the pass repeated. A key listed under both verdicts counts as block.
    """
    judge = Judge(rules)
    listed = {v: {_key(h, p) for verdict, h, p in rules if verdict == v} for v in ("block", "allow")}
    listed["allow"] -= listed["block"]
    column = urls.select(F.col(f"`{url_col}`").alias("url"))
    distinct = max(1, column.agg(F.approx_count_distinct("url")).first()[0]) * len(judge.depths) * len(judge.lengths)
    total = sum(map(len, listed.values()))
    rate = min(0.5, max(1e-9, total / distinct))
    while True:
        first = {v: Bloom(keys, rate, 0) for v, keys in listed.items()}

        def passed(batches, first=first):
            seen: set[tuple[str, str]] = set()
            for batch in batches:
                new = set()
                for url in set(batch.column(0).to_pylist()):
                    for h, p in judge.candidates(*parts(url)):
                        key = _key(h, p)
                        new.update((v, key) for v, bloom in first.items() if key in bloom and (v, key) not in seen)
                if len(seen) < 100_000:
                    seen |= new
                if new:
                    yield pa.record_batch([pa.array(x, pa.string()) for x in zip(*sorted(new), strict=True)], ["verdict", "key"])

        found = column.mapInArrow(freed(passed), "verdict string, key string").distinct().limit(8 * total + 1001).collect()
        if len(found) <= 8 * total + 1000:
            break
        rate /= 64
    mistaken = {v: {r.key for r in found if r.verdict == v} - keys for v, keys in listed.items()}
    return judge, {v: Cascade(first[v], keys, mistaken[v]) for v, keys in listed.items()}


def judge_urls(pages: DataFrame, rules: list[Rule] = RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Host, path, the longest fitting rule and its verdict for every URL.

    Longest counts host and path together, ties by host. Where no rule fits, the rule is null
    and the verdict is `default` (no key of the URL is listed). Null URLs and URLs without ://
    have empty host and path. Repeated rows give a row each; other columns are not read.
    """
    judge, cascades = fit(pages, rules, url_col)

    def run(batches):
        for batch in batches:
            rows = []
            for url in batch.column(1).to_pylist():
                host, path = parts(url)
                rule, verdict = None, default
                for h, p in judge.candidates(host, path):
                    key = _key(h, p)
                    hit = next((v for v, cascade in cascades.items() if key in cascade), None)
                    if hit:
                        rule, verdict = h + p, hit
                        break
                rows.append((host, path, rule, verdict))
            yield pa.record_batch([batch.column(0), *(pa.array(list(x), pa.string()) for x in (zip(*rows, strict=True) if rows else [()] * 4))], ["page_id", "host", "path", "rule", "verdict"])

    return pages.selectExpr(f"`{id_col}` AS page_id", f"`{url_col}` AS url").mapInArrow(freed(run), "page_id long, host string, path string, rule string, verdict string")


SQL = """
WITH r AS (
  SELECT page_id, CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN '' ELSE substr(url, position('://' IN url) + 3) END AS rest FROM pages
), h AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM r
), p AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h
), f AS (
  SELECT *, host = 'example.org' OR ends_with(host, '.example.org') AS eo, host = 'org' OR ends_with(host, '.org') AS org,
         host = 'com' OR ends_with(host, '.com') AS com FROM p
), g AS (
  SELECT page_id, host, path,
         CASE WHEN eo AND starts_with(path, '/en/1') THEN 'example.org/en/1'
              WHEN eo AND starts_with(path, '/es/') THEN 'example.org/es/'
              WHEN com AND starts_with(path, '/fr/') THEN 'com/fr/'
              WHEN com AND starts_with(path, '/de/') THEN 'com/de/'
              WHEN org AND starts_with(path, '/') THEN 'org/' END AS rule FROM f
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM g
"""
