"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a domain with a path prefix, or a regular expression with the literal tokens that any match must
hold. The index files each rule under that one of its tokens that the fewest URLs have, counted over
all URLs; a URL's tokens fetch the candidate rules, and only these run. A rule without tokens
is a candidate for every URL. Domain rules (the longest that fits wins) go before pattern
rules (the first listed wins); a URL that no rule fits gets the default.

A null URL, or one without ://, has an empty host and path and fits no rule. Repeated rows are judged each, null ids and
extra columns stay; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import LOWER, UPPER, unused

TOKEN = re.compile("[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """verdict for hosts under domain with a path that starts with path; or, with a pattern, for what it is found in: host, NUL, path."""

    verdict: str
    domain: str = ""
    path: str = "/"
    pattern: str = ""
    literals: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return self.pattern or self.domain + self.path

    @property
    def tokens(self) -> tuple[str, ...]:
        """Whole tokens of any URL that the rule fits. The path's last may go on, unless a separator ends it."""
        if self.pattern:
            return self.literals
        path = TOKEN.findall(self.path.translate(str.maketrans(UPPER, LOWER)))
        return (*TOKEN.findall(self.domain), *(path[:-1] if self.path[-1:].isalnum() else path))

    @property
    def regex(self) -> re.Pattern[str]:
        if self.pattern:
            return re.compile(self.pattern)
        return re.compile(rf"(?:[^\0]*\.)?{re.escape(self.domain)}\0{re.escape(self.path)}")


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)

#: What the method adds: words of unwanted hosts. Each rule has a token, so that none runs on every URL.
UNWANTED = ("casino", "poker", "gambling", "free-bets", "pills", "viagra", "payday-loans", "ads-track", "spam-farm", "warez", "porn", "xxx")
PATTERNS = tuple(Rule("block", pattern=rf"^[^\0]*\b{w}\b", literals=tuple(w.split("-"))) for w in UNWANTED)


def host(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def index(frame: DataFrame, rules: tuple[Rule, ...]) -> dict[str, list[Rule]]:
    """Rules by their rarest token; under '' those without. The counts are of the rules' tokens alone."""
    names = sorted({t for r in rules for t in r.tokens})
    lower = F.translate(F.concat_ws(" ", "host", "path"), UPPER, LOWER)
    seen = frame.select(F.explode(F.array_intersect(F.split(lower, "[^a-z0-9]+"), F.array(*map(F.lit, names)))).alias("t")).groupBy("t").count()
    counts = {r["t"]: r["count"] for r in seen.collect()} if names else {}
    filed = defaultdict(list)
    for r in rules:
        filed[min(r.tokens, key=lambda t: (counts.get(t, 0), t), default="")].append(r)
    return dict(filed)


def judge(pages: DataFrame, rules: tuple[Rule, ...] = (*RULES, *PATTERNS), default: str = "allow", url: str = "url") -> DataFrame:
    """pages with host, path, rule (the domain rule that decided), matched (any rule that did) and verdict; columns of pages with these names are replaced."""
    added = {"host", "path", "rule", "matched", "verdict"} - {url}
    frame = pages.drop(*added).withColumns({"host": host(F.col(url)), "path": path(F.col(url))})
    filed = index(frame, rules)
    order = {r: k for k, r in enumerate(rules)}

    @F.pandas_udf("struct<rule:string,matched:string,verdict:string>")
    def verdict(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        compiled = {r: r.regex for r in order}
        for hosts, paths in parts:
            out = []
            for h, p in zip(hosts, paths, strict=True):
                both = f"{h}\0{p}"
                tokens = {"", *TOKEN.findall(both.translate(str.maketrans(UPPER, LOWER)))}
                fits = [r for t in tokens for r in filed.get(t, ()) if (compiled[r].search if r.pattern else compiled[r].match)(both)] if h else []
                best = max((r for r in fits if not r.pattern), key=lambda r: (len(r.name), -order[r]), default=None)
                first = best or min(fits, key=order.get, default=None)
                out.append((best and best.name, first and first.name, first.verdict if first else default))
            yield pd.DataFrame(out, columns=["rule", "matched", "verdict"])

    name = unused(frame, "judged")
    return frame.withColumn(name, verdict("host", "path")).select(*frame.columns, *(F.col(f"{name}.{c}").alias(c) for c in ("rule", "matched", "verdict")))
