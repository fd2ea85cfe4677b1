"""Operator 9, URL filter: path rules first, then a weighted vocabulary found by Aho-Corasick.

Rules are (host, path) pairs that fit a host and its subdomains; the longest fitting rule decides. Urls that
no rule fits are searched for vocabulary terms with one automaton. A term counts where no letter or digit
(a-z, 0-9, after lower-casing A-Z) stands beside it, once per url however often it occurs. A url is blocked
when the weights of its distinct terms reach 1: one strict term (weight 1) or two soft ones (weight 0.5).

Defined cases: a null or empty url, or one without ``://``, has empty host and path, fits no rule and is
judged by its text alone (null: no terms, allow). Rows are judged one by one, so repeated rows and null ids
pass through; other input columns are kept unless they carry an output name, which the output replaces.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (host, path, verdict): a short list by design; a rule costs a comparison per row.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))
STRICT = ("adult", "casino", "escort", "gambling", "hentai", "malware", "phishing", "porn", "spam", "viagra", "warez", "xxx")
SOFT = ("ad", "ads", "bet", "bets", "bonus", "cheap", "click", "farm", "free", "loan", "loans", "pill", "pills",
        "poker", "sex", "slots", "track", "tracker", "win", "winner")


def vocabulary(strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT) -> dict[str, tuple[str, float]]:
    return {t: ("soft", 0.5) for t in soft} | {t: ("strict", 1.0) for t in strict}


def _automaton(terms: dict[str, tuple[str, float]]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for t in terms:
        a.add_word(t, t)
    a.make_automaton()
    return a


_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
_BESIDE = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def terms_in(url: str, automaton: ahocorasick.Automaton) -> set[str]:
    """The distinct vocabulary terms that stand in ``url`` with no letter or digit beside them."""
    text = url.translate(_ASCII_LOWER)
    found = set()
    for end, term in automaton.iter(text):
        start = end + 1 - len(term)
        if not (start and text[start - 1] in _BESIDE) and not (end + 1 < len(text) and text[end + 1] in _BESIDE):
            found.add(term)
    return found


def _hits(terms: dict[str, tuple[str, float]]):
    @F.pandas_udf("strict_hits int, soft_hits int, weight double")
    def hits(urls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = _automaton(terms)
        for batch in urls:
            rows = []
            for url in batch:
                got = terms_in(url, automaton) if isinstance(url, str) and len(automaton) else ()
                kinds = [terms[t][0] for t in got]
                rows.append((kinds.count("strict"), kinds.count("soft"), sum(terms[t][1] for t in got)))
            yield pd.DataFrame(rows, columns=["strict_hits", "soft_hits", "weight"])
    return hits


def host_of(url: Column) -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(host: str, path: str) -> Column:
    h = F.col("host")
    return ((h == host) | h.endswith("." + host)) & F.col("path").startswith(path)


def judge_urls(pages: DataFrame, url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES,
               terms: dict[str, tuple[str, float]] | None = None) -> DataFrame:
    """Add host, path, rule, verdict, strict_hits, soft_hits and weight to every row."""
    out = pages.withColumn("_u", F.col(url))
    out = out.withColumns({"host": host_of(F.col("_u")), "path": path_of(F.col("_u"))})
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]), r)):  # the longest comes outermost
        rule = F.when(_fits(host, path), F.lit(host + path)).otherwise(rule)
        ruled = F.when(_fits(host, path), F.lit(verdict)).otherwise(ruled)
    out = out.withColumn("_h", _hits(terms or vocabulary())(F.col("_u")))
    by_terms = F.when(F.col("_h.weight") >= 1.0, "block").otherwise("allow")
    return out.withColumns({"rule": rule, "verdict": F.coalesce(ruled, by_terms), "strict_hits": F.col("_h.strict_hits"),
                            "soft_hits": F.col("_h.soft_hits"), "weight": F.col("_h.weight")}).drop("_u", "_h")


def _sql() -> str:
    def present(t: str) -> str:
        return f"CAST(regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS INT)"

    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    ranked = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), -len(r[0])))
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH p AS (
  SELECT page_id, coalesce({low.format("regexp_extract(url, '://([^/?#]*)', 1)")}, '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path, coalesce({low.format("url")}, '') AS u
  FROM pages),
h AS (
  SELECT *, CAST({' + '.join(map(present, STRICT))} AS INT) AS strict_hits, CAST({' + '.join(map(present, SOFT))} AS INT) AS soft_hits,
    CASE {' '.join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in ranked)} END AS rule,
    CASE {' '.join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in ranked)} END AS ruled
  FROM p)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN strict_hits + 0.5 * soft_hits >= 1 THEN 'block' ELSE 'allow' END) AS verdict,
  strict_hits, soft_hits, CAST(strict_hits + 0.5 * soft_hits AS DOUBLE) AS weight
FROM h"""


ORACLE = _sql()
