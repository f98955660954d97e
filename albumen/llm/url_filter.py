"""URL filter: allow and block rules by host and path, then a weighted
vocabulary counted by an Aho-Corasick automaton."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The default vocabulary. A strict term rejects alone; soft ones weigh in.
STRICT = ("bestiality", "camgirls", "escorts", "hentai", "malware", "phishing", "porn", "porno", "pornhub", "ransomware", "viagra", "warez", "xvideos", "xxx")
SOFT = {
    "ads": 2, "adult": 2, "bet": 2, "bets": 2, "betting": 2, "bonus": 1, "buy": 1, "cam": 1, "casino": 2, "cheap": 1, "click": 1, "coupon": 1,
    "crack": 2, "download": 1, "erotic": 2, "escort": 2, "farm": 1, "free": 1, "gambling": 2, "girls": 1, "hot": 1, "jackpot": 2, "keygen": 2,
    "loan": 1, "loans": 1, "lottery": 2, "naked": 2, "nude": 2, "nudes": 2, "payday": 2, "pharmacy": 1, "pills": 2, "poker": 2, "promo": 1,
    "replica": 1, "serial": 1, "sex": 2, "sexy": 2, "slots": 2, "spam": 2, "torrent": 2, "track": 1, "win": 1,
}
SOFT_LIMIT = 3  # weight of several distinct soft terms that rejects
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """Between the first :// and the next / ? # or the end, A-Z lower-cased; else empty."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def vocabulary_hits(strict: Iterable[str], soft: dict[str, int]):
    """A vectorised function url -> (strict hits, distinct soft terms, their weight). Terms are
    looked for once escapes of ASCII characters are undone; a term counts between characters
    that are neither letters nor digits. A task builds the automaton once."""
    strict, soft = {t.lower() for t in strict}, {t.lower(): w for t, w in soft.items()}

    @F.pandas_udf("strict_hits int, soft_terms int, soft_weight int")
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for term in strict | soft.keys():
            machine.add_word(term, term)
        machine.make_automaton()
        for urls in batches:
            rows = []
            for url in urls:
                text = _ESCAPE.sub(lambda m: chr(int(m[1], 16)), url or "").translate(_FOLD)
                n, found = 0, set()
                for end, term in machine.iter(text) if len(machine) else ():
                    start = end - len(term) + 1
                    if start and text[start - 1].isalnum() or end + 1 < len(text) and text[end + 1].isalnum():
                        continue
                    n += term in strict
                    found.add(term)
                some = [soft[t] for t in found if t in soft and t not in strict]
                rows.append((n, len(some), sum(some)))
            yield pd.DataFrame(rows, columns=["strict_hits", "soft_terms", "soft_weight"])

    return hits


_ESCAPE = re.compile("%([2-7][0-9A-Fa-f])")
_FOLD = {c: c + 32 for c in range(65, 91)}


def filter_urls(
    df: DataFrame,
    url: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES,
    strict: Iterable[str] = STRICT,
    soft: dict[str, int] | None = None,
    soft_limit: int = SOFT_LIMIT,
) -> DataFrame:
    """Add host, path, rule, verdict and the vocabulary counts to every row.

    rules are (allow or block, host, path prefix): one fits its host and all
    subdomains where the path starts with its prefix; the longest fitting rule
    (host and prefix together; on ties the longer host) decides. Without one,
    a row is blocked by one strict term, or by two or more distinct soft terms whose
    weights reach soft_limit. A term counts only between characters that are neither
    letters nor digits; escapes like %61 are read as what they stand for.

    A null url, or one without ://, has an empty host and path, no rule, and its
    text is still judged by the vocabulary (null: allowed). Other columns stay;
    columns named like the added ones are replaced. Rules and vocabulary are
    small parameters that travel with the plan; there is no shuffle.
    """
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r))
    host, path = F.col("host"), F.col("path")
    fits = [(verdict, h.lower() + p, ((host == h.lower()) | host.endswith("." + h.lower())) & path.startswith(p)) for verdict, h, p in order]
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, name, test in reversed(fits):
        rule = F.when(test, F.lit(name)).otherwise(rule)
        ruled = F.when(test, F.lit(verdict)).otherwise(ruled)
    hits = vocabulary_hits(strict, SOFT if soft is None else soft)
    out = df.withColumn("__hits", hits(F.col(url)))
    out = out.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    out = out.withColumns({"rule": rule, "__ruled": ruled})
    out = out.withColumns({k: F.col(f"__hits.{k}") for k in ("strict_hits", "soft_terms", "soft_weight")})
    method = F.when((F.col("strict_hits") >= 1) | (F.col("soft_terms") >= 2) & (F.col("soft_weight") >= soft_limit), "block").otherwise("allow")
    return out.withColumn("verdict", F.coalesce("__ruled", method)).drop("__hits", "__ruled")


def op1_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_terms", "soft_weight")


def oracle() -> str:
    def fits(h: str, p: str) -> str:
        return f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"

    order = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in order)
    ruled = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in order)

    def count(term: str) -> str:
        return f"len(regexp_extract_all(regexp_replace(low, '([^\\p{{L}}\\p{{N}}])', '\\1\\1', 'g'), '(^|[^\\p{{L}}\\p{{N}}]){term}($|[^\\p{{L}}\\p{{N}}])'))"

    def one(term: str) -> str:
        return f"CASE WHEN {count(term)} > 0 THEN 1 ELSE 0 END"

    strict = " + ".join(count(t) for t in STRICT)
    terms = " + ".join(one(t) for t in SOFT)
    weight = " + ".join(f"{w} * {one(t)}" for t, w in SOFT.items())
    return f"""
WITH u AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    translate(array_to_string(list_transform(string_split(coalesce(url, ''), '%'), lambda x, i: CASE WHEN i = 1 THEN x WHEN regexp_matches(x, '^[2-7][0-9A-Fa-f]') THEN decode(unhex(x[1:2])) || x[3:] ELSE '%' || x END), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM pages),
v AS (SELECT page_id, host, path, CASE {rule} END AS rule, CASE {ruled} END AS ruled,
    CAST({strict} AS INTEGER) AS strict_hits, CAST({terms} AS INTEGER) AS soft_terms, CAST({weight} AS INTEGER) AS soft_weight FROM u)
SELECT page_id, host, path, rule,
  coalesce(ruled, CASE WHEN strict_hits >= 1 OR soft_terms >= 2 AND soft_weight >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
  strict_hits, soft_terms, soft_weight
FROM v"""
