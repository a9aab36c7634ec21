"""URL rules answered by Bloom filter cascades: exact for every key of the corpus, without a join."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.base import free

#: Bytes of all rules' keys at most: they are sent to every executor.
RULE_BYTES = 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = ""

    @property
    def key(self) -> str:
        return self.host + self.path


class Bloom:
    """A Bloom filter of a given false-positive rate; salt parts the levels' hashes."""

    def __init__(self, keys: Iterable[str], rate: float, salt: int) -> None:
        keys = list(keys)
        self.salt = salt
        self.size = max(64, math.ceil(-len(keys) * math.log(rate) / math.log(2) ** 2))
        self.hashes = max(1, round(self.size / max(1, len(keys)) * math.log(2))) if keys else 1
        self.hashes = min(self.hashes, 40)
        bits = np.zeros(self.size, bool)
        for key in keys:
            bits[list(self._places(key))] = True
        self.bits = np.packbits(bits, bitorder="little").tobytes()

    def _places(self, key: str) -> Iterator[int]:
        both = xxhash.xxh3_128_intdigest(key.encode("utf-8", "surrogatepass"), self.salt)
        one, two = both & (1 << 64) - 1, both >> 64 | 1
        return ((one + k * two) % self.size for k in range(self.hashes))

    def __contains__(self, key: str) -> bool:
        bits = self.bits
        return all(bits[p >> 3] >> (p & 7) & 1 for p in self._places(key))


class Cascade:
    """Levels in turn hold what the level before let through wrongly: keys listed, keys of the universe that aren't, and so on
    until none is left. A key of the universe is listed exactly if the first level without it is at an odd place."""

    def __init__(self, first: Bloom, listed: Iterable[str], wrong: Iterable[str]) -> None:
        """first: level 0, holding listed; wrong: all unlisted keys of the universe that it lets through."""
        self.levels = [first]
        inside, outside = list(listed), list(wrong)
        while outside:
            self.levels.append(level := Bloom(outside, 0.5, first.salt + len(self.levels)))
            inside, outside = outside, [x for x in inside if x in level]

    def __contains__(self, key: str) -> bool:
        for k, level in enumerate(self.levels):
            if key not in level:
                return k % 2 == 1
        return len(self.levels) % 2 == 1


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: from there up to ? or # or the end. Both are
    empty for a null url and for one without ://."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def candidates(host: str, path: str, lengths: list[int]) -> Iterator[str]:
    """The keys that could be rules for a url, longest first: each ending of the host at a dot, each beginning of the path of a
    length that rules have."""
    found, at = [], 0
    while True:
        found += [host[at:] + path[:n] for n in lengths if n <= len(path)]
        at = host.find(".", at) + 1
        if not at:
            break
    return iter(sorted(found, key=lambda x: -len(x)))


def build(urls: DataFrame, rules: list[Rule]) -> dict[str, Cascade]:
    """A cascade for each verdict. urls: (host, path), all of the corpus: its candidate keys are the universe. The first level's
    rate is the list's size over the universe's, so the keys that it lets through wrongly number about as many as the list:
    these alone come to the driver, whatever the corpus's size; should they be more, the level is built anew with a lower rate."""
    lengths = sorted({len(r.path) for r in rules}, reverse=True)
    lists = {v: sorted({r.key for r in rules if r.verdict == v}) for v in sorted({r.verdict for r in rules})}
    universe = urls.agg(F.sum(F.size(F.split("host", r"\.")) * len(lengths))).first()[0] or 1
    share = 1.0
    while True:
        first = {v: Bloom(keys, min(0.5, share * len(keys) / (math.sqrt(2) * universe)), 1000 * k) for k, (v, keys) in enumerate(lists.items())}

        def passing(batches: Iterator[pd.DataFrame], first=first) -> Iterator[pd.DataFrame]:
            own = {v: set(keys) for v, keys in lists.items()}
            for batch in batches:
                found = {(v, key) for host, path in set(zip(batch["host"], batch["path"])) for key in candidates(host, path, lengths) for v, level in first.items() if key in level and key not in own[v]}
                yield pd.DataFrame(sorted(found), columns=["verdict", "key"])

        bound = 1000 + 4 * len(rules)
        wrong = urls.mapInPandas(passing, "verdict string, key string").distinct().limit(bound + 1).collect()
        if len(wrong) <= bound:
            return {v: Cascade(first[v], lists[v], [r["key"] for r in wrong if r["verdict"] == v]) for v in lists}
        share /= 16


def judge(pages: DataFrame, rules: list[Rule], url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages with columns host, path, rule, verdict (host and path as in host_and_path). A rule fits its host and all its
    subdomains if the path starts with the rule's; of several the longest (host and path together) decides; without one the
    rule is null and the verdict is that of a key on no list: default. Rules must not contradict one another.

    The rules are driver-side data, sent to executors only as cascades (and, while these are built, as the list); urls are
    read twice, never shuffled. Rules of more than RULE_BYTES in all are an error: a broadcast must have a bound. Null urls have an empty host and path; repeated rows are judged alike; columns named like the
    four are replaced, the one of the urls included; an empty table gives an empty result.
    """
    verdict_of: dict[str, str] = {}
    for r in rules:
        if verdict_of.setdefault(r.key, r.verdict) != r.verdict:
            raise ValueError(f"both verdicts for {r.key}")
    if sum(len(key.encode()) for key in verdict_of) > RULE_BYTES:
        raise ValueError(f"rules of more than {RULE_BYTES} bytes")
    host, path = host_and_path(F.col(url_col))
    parted, found = free(pages, "__url", "__rule")
    rows = pages.withColumn(parted, F.struct(host.alias("host"), path.alias("path")))
    cascades = build(rows.select(f"{parted}.host", f"{parted}.path"), rules)
    lengths = sorted({len(r.path) for r in rules}, reverse=True)

    @F.pandas_udf("rule string, verdict string")
    def decide(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        known: dict[tuple[str, str], tuple[str | None, str]] = {}
        for both in zip(hosts, paths):
            if both not in known:
                known[both] = next(((key, v) for key in candidates(*both, lengths) for v, cascade in cascades.items() if key in cascade), (None, default))
        return pd.DataFrame([known[both] for both in zip(hosts, paths)], columns=["rule", "verdict"])

    rows = rows.withColumn(found, decide(f"{parted}.host", f"{parted}.path"))
    return rows.withColumns({"host": F.col(f"{parted}.host"), "path": F.col(f"{parted}.path"), "rule": F.col(f"{found}.rule"), "verdict": F.col(f"{found}.verdict")}).drop(parted, found)
