"""URL filtering by pattern rules that are indexed by their rarest literal token (DataFrame functions only).

A rule is a regular expression over ``host + path`` together with literal tokens that every
matching URL is bound to contain. Each rule is filed under the one of its tokens that the
corpus of URLs holds least often. A URL's own tokens look up the index, so that only the
rules filed under one of them run their regular expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import table

_CUT = r"[^A-Za-z0-9]+"
#: So many rules are constants of the plan; more, and rules that come as a table, are joined.
MAX_RULES = 1_000


@dataclass(frozen=True)
class UrlRule:
    """rank: higher wins. label: what the result names (null for pattern rules)."""

    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    rank: int
    label: str | None = None


def host_rule(host: str, path: str, verdict: str) -> UrlRule:
    """A rule for a host, all its subdomains and the paths that start with ``path``; longer rules win."""
    # the last piece of a path may go on in the URL, so it is no token unless a delimiter ends it
    closed = re.sub(r"[A-Za-z0-9]+$", "", path)
    tokens = tuple(t for t in re.split(_CUT, f"{host}/{closed}") if t)
    pattern = rf"(?s)^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}"
    return UrlRule(pattern, tokens, verdict, 1_000_000 + len(host) + len(path), host + path)


def pattern_rule(pattern: str, tokens: tuple[str, ...], verdict: str, rank: int = 0) -> UrlRule:
    return UrlRule(pattern, tokens, verdict, rank)


BASE_RULES = (
    host_rule("org", "/", "allow"),
    host_rule("example.org", "/es/", "block"),
    host_rule("example.org", "/en/1", "block"),
    host_rule("com", "/fr/", "allow"),
    host_rule("com", "/de/", "block"),
)

def word_rule(words: str, verdict: str, rank: int = 0, host_only: bool = False) -> UrlRule:
    """A rule for urls with these words, joined as they stand, between other signs than letters and digits."""
    before = "(?s)^(?:[^/]*[^A-Za-z0-9/])?" if host_only else "(?s)(?:^|[^A-Za-z0-9])"
    return UrlRule(f"{before}{re.escape(words)}(?:[^A-Za-z0-9]|$)", tuple(t for t in re.split(_CUT, words) if t), verdict, rank)


#: What the method judges where no base rule fits: words of junk anywhere, of junk hosts, and of pages that hold no text.
JUNK_WORDS = (
    "adultdating betting bingo blackjack camgirls casino cialis escort escorts gambling hentai jackpot keygen levitra loans lottery malware nude nudes onlyfans payday "
    "phentermine phishing poker porn porno roulette sexcam slots spyware sportsbook torrent torrents tramadol viagra warez xanax xxx"
).split()
JUNK_HOSTS = "spam-farm cheap-pills link-farm seo-links free-money buy-followers fake-watches click-farm".split()
JUNK_PATHS = ("/cgi-bin/", "/wp-login.php", "/xmlrpc.php", "/wp-admin/", "/phpmyadmin/", "/trackback/", "/captcha/", "/add-to-cart/", "/checkout/")
JUNK_RULES = (
    *(word_rule(w, "block") for w in JUNK_WORDS),
    *(word_rule(w, "block", host_only=True) for w in JUNK_HOSTS),
    *(pattern_rule(f"(?s)/(?:.*/)?{re.escape(w[1:])}" + ("" if w.endswith("/") else "(?:[^A-Za-z0-9]|$)"), tuple(t for t in re.split(_CUT, w) if t), "block") for w in JUNK_PATHS),
)


def url_parts(df: DataFrame, url: str) -> DataFrame:
    """Adds __host and __path."""
    at = F.expr(f"instr(`{url}`, '://')")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    df = df.withColumn("__rest", rest)
    ascii_low = F.translate(F.regexp_extract("__rest", r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return df.withColumn("__host", ascii_low).withColumn("__path", F.regexp_extract("__rest", r"(?s)^[^/?#]*([^?#]*)", 1)).drop("__rest")


def token_counts(urls: DataFrame, tokens: list[str]) -> dict[str, int]:
    """How often each of the rules' tokens stands in all the URLs (__host, __path); bounded by the rules."""
    if not tokens:
        return {}
    spark = urls.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(t,) for t in tokens], "token string"))  # at most the rules' own tokens
    seen = urls.select(F.explode(F.array_distinct(F.split(F.concat("__host", "__path"), _CUT))).alias("token"))
    return {r.token: r.n for r in seen.join(wanted, "token").groupBy("token").agg(F.count("*").alias("n")).collect()}


def build_index(urls: DataFrame, rules: tuple[UrlRule, ...]) -> tuple[list[list[tuple[str, int]]], list[int]]:
    """Hash places, each a list of (token, rule number), and the numbers of rules without a token."""
    counts = token_counts(urls, sorted({t for r in rules for t in r.tokens}))
    filed = [(min(r.tokens, key=lambda t: (counts.get(t, 0), t)), i) for i, r in enumerate(rules) if r.tokens]
    places = 1 << max(4, (2 * len(filed)).bit_length())
    index: list[list[tuple[str, int]]] = [[] for _ in range(places)]
    if filed:
        spark = urls.sparkSession
        tokens = sorted({t for t, _ in filed})
        at = {r.t: r.h for r in spark.createDataFrame([(t,) for t in tokens], "t string").select("t", F.pmod(F.xxhash64("t"), F.lit(places)).alias("h")).collect()}
        for t, i in filed:
            index[at[t]].append((t, i))
    return index, [i for i, r in enumerate(rules) if not r.tokens]


def judge_urls(df: DataFrame, rules: tuple[UrlRule, ...] | DataFrame = BASE_RULES + JUNK_RULES, url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to every row.

    Null urls and urls without ``://`` have an empty host and path and take the default verdict.
    Of several rules that fit, the highest rank wins, then the last label, then the last verdict in
    code-point order. Equal rows are judged each by itself, long urls whole. Input columns named host,
    path, rule or verdict are replaced. An empty table gives an empty result. With up to MAX_RULES
    rules nothing is shuffled but the counts of the rules' tokens, so hot hosts cost nothing. More
    rules, or a table of rules (pattern, tokens, verdict, rank, label), are joined by their rarest token.
    """
    keep = [c for c in df.columns if c.lower() not in {"host", "path", "rule", "verdict"} or c == url]
    parts = url_parts(df.select(*keep), url)
    if isinstance(rules, DataFrame):
        parts = _by_table(parts, rules)
    elif len(rules) > MAX_RULES:
        rows = [(r.pattern, list(r.tokens), r.verdict, r.rank, r.label) for r in rules]
        parts = _by_table(parts, df.sparkSession.createDataFrame(rows, "pattern string, tokens array<string>, verdict string, rank int, label string"))
    else:
        parts = _by_constants(parts, rules)
    best = F.col("__best")
    return parts.select(*[F.col(c) for c in keep], F.col("__host").alias("host"), F.col("__path").alias("path"), best["label"].alias("rule"), F.coalesce(best["verdict"], F.lit(default)).alias("verdict"))


_BEST = "struct<rank:int,label:string,verdict:string>"


def _by_constants(parts: DataFrame, rules: tuple[UrlRule, ...]) -> DataFrame:
    """Adds __best. The index is a hash table in the plan; each pattern is compiled once in a task."""
    if not rules:
        return parts.withColumn("__best", F.lit(None).cast(_BEST))
    index, always = build_index(parts, rules)
    empty = F.array().cast("array<struct<token:string,rule:int>>")
    places = F.array(*(F.array(*(F.struct(F.lit(t).alias("token"), F.lit(i).alias("rule")) for t, i in p)) if p else empty for p in index))
    facts = F.array(*(F.struct(F.lit(r.rank).alias("rank"), F.lit(r.label).cast("string").alias("label"), F.lit(r.verdict).alias("verdict")) for r in rules))
    parts = parts.withColumn("__url", F.concat("__host", "__path")).withColumn("__tokens", F.array_distinct(F.split("__url", _CUT)))

    def of_token(t: Column) -> Column:
        filed = F.element_at(places, F.pmod(F.xxhash64(t), F.lit(len(index))).cast("int") + 1)
        return F.transform(F.filter(filed, lambda e: e["token"] == t), lambda e: e["rule"])

    def fits(i: Column) -> Column:
        found = F.lit(False)
        for nr, r in reversed(list(enumerate(rules))):
            found = F.when(i == nr, F.col("__url").rlike(r.pattern)).otherwise(found)
        return found

    fetched = F.array_union(F.flatten(F.transform("__tokens", of_token)), F.lit(always).cast("array<int>") if always else F.array().cast("array<int>"))
    parts = parts.withColumn("__rules", fetched)
    return parts.withColumn("__best", F.array_max(F.transform(F.filter("__rules", fits), lambda i: F.element_at(facts, i + 1))))


def _by_table(parts: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds __best. Different urls' tokens are joined to the rules filed under them; no list of rules or tokens is gathered.

    Rules need a token each. A token that many urls hold is split among tasks by adaptive execution's
    handling of skewed joins, and is only used by rules of which no token is rarer.
    """
    if rules.where("tokens IS NULL OR size(tokens) = 0").limit(1).count():
        raise ValueError("rules of a table need a literal token")
    urls = parts.select("__host", "__path").distinct().withColumn("__url", F.concat("__host", "__path"))
    held = urls.select("__host", "__path", "__url", F.explode(F.array_distinct(F.split("__url", _CUT))).alias("token"))
    numbered = rules.select(F.xxhash64("pattern", "rank", "label", "verdict").alias("nr"), *rules.columns)
    wanted = numbered.select("nr", F.explode("tokens").alias("token"))
    counts = held.join(wanted.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    filed = wanted.join(counts, "token", "left").groupBy("nr").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    index = numbered.join(filed, "nr").select("token", "pattern", F.struct(F.col("rank").cast("int").alias("rank"), "label", "verdict").alias("fact"))
    best = held.join(index, "token").where("__url RLIKE pattern").groupBy("__host", "__path").agg(F.max("fact").cast(_BEST).alias("__best"))
    return parts.join(best, ["__host", "__path"], "left")


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


_JUNK = " OR ".join("regexp_matches(host || path, '" + r.pattern.replace("'", "''") + "')" for r in JUNK_RULES)

OP5_SQL = rf"""
WITH r AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r
), q AS (
  SELECT page_id, host, path,
    CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
         WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
         WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
         WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM p
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN {_JUNK} THEN 'block'
       ELSE 'allow' END AS verdict
FROM q
"""
