"""URL filters with host-and-path rules and pattern rules, native Spark expressions only.

Every rule has literal tokens and a regular expression. Rules are indexed by their rarest token, counted over the urls to be
judged. A url fetches, by its own distinct tokens, the rules filed under one of them; only these candidates run their regular
expression. A rule without a token of its own is filed under the empty token, which every url has.

Host rules. host: after the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case. path: from there up to `?`, `#` or the
end. Null urls and urls without `://` have both empty and fit no host rule. A rule fits its host and all subdomains if the path
starts with the rule's path; the longest rule (host and path characters) wins, equal lengths the alphabetically first.

Pattern rules judge the urls that no host rule fits; they see the whole url with A-Z in lower case. `*` stands for any
characters, `^` for a separator (neither letter, digit nor one of `_.%-`) or the end, `||` in front for the start of the host or
of a label of it, `|` in front or behind for the start or the end; all else is literal. The longest pattern wins, equal lengths
the alphabetically first. What no rule fits gets DEFAULT_VERDICT.

Repeated rows are judged row by row, very long urls whole; a null page_id stays null. An empty table gives an empty result,
further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.llm.common import durable

#: host, path prefix, verdict.
DEFAULT_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
#: pattern, verdict: advertising and tracking hosts, adult and gambling pages, accounts and carts, programs and archives.
DEFAULT_PATTERNS = [
    ("||ads-track.", "block"),
    ("||ads.", "block"),
    ("||adserver*.", "block"),
    ("||doubleclick.", "block"),
    ("^casino^", "block"),
    ("^poker^*bonus", "block"),
    ("^porn^", "block"),
    ("^xxx^", "block"),
    ("^casino^*^history^", "allow"),
    ("/cgi-bin/", "block"),
    ("/wp-login.", "block"),
    ("/cart^", "block"),
    ("/checkout^", "block"),
    ("^jsessionid=", "block"),
    ("^phpsessid=", "block"),
    (".apk|", "block"),
    (".exe|", "block"),
    (".zip|", "block"),
    ("|ftp://", "block"),
]
#: What a url gets that no rule fits.
DEFAULT_VERDICT = "allow"
#: Rule tables of up to so many rows become one literal map from token to rules; larger ones are joined on the token. Both give the same.
LITERAL_RULES = 256

RULE_SCHEMA = "rule_host string, rule_path string, rule_verdict string"
PATTERN_SCHEMA = "rule string, rule_verdict string"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINNER = "struct<n:int,rule:string,rule_verdict:string>"


def host_column(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_column(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_tokens(host: Column, path: Column) -> Column:
    """Host labels as h:<label> and complete leading path segments as p:<segment>."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.regexp_extract_all(path, F.lit("([^/]+)(?=/)"), 1), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(labels, segments))


def url_tokens(url: Column) -> Column:
    """The empty token and the url's runs of letters and digits."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all(url, F.lit("([a-z0-9]+)"), 1)))


def rule_frame(spark: SparkSession, rules=DEFAULT_RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), RULE_SCHEMA)


def pattern_frame(spark: SparkSession, patterns=DEFAULT_PATTERNS) -> DataFrame:
    return spark.createDataFrame(list(patterns), PATTERN_SCHEMA)


def compiled_hosts(rules: DataFrame) -> DataFrame:
    """rule, rule_verdict, regex over `host path` and tokens of host rules."""
    quoted = lambda c: F.concat(F.lit(r"\Q"), c, F.lit(r"\E"))  # noqa: E731  a host has no slash, so host and path stay apart
    regex = F.concat(F.lit(r"^(?:[^/]*\.)?"), quoted(F.col("rule_host")), F.lit(r"(?=/|\z)"), quoted(F.col("rule_path")))
    return rules.select(F.concat("rule_host", "rule_path").alias("rule"), "rule_verdict", regex.alias("regex"), host_tokens(F.col("rule_host"), F.col("rule_path")).alias("tokens"))


def compiled_patterns(patterns: DataFrame) -> DataFrame:
    """rule, rule_verdict, regex over the url and tokens of pattern rules: runs that both ends of which the pattern fixes."""
    rule = F.col("rule")
    body = F.regexp_replace(F.regexp_replace(rule, r"^\|\|?", ""), r"\|$", "")
    body = F.regexp_replace(body, r"([.+?$()\[\]{}\\|])", r"\\$1")
    body = F.replace(F.replace(body, F.lit("*"), F.lit(".*")), F.lit("^"), F.lit(r"(?:[^a-z0-9_.%-]|\z)"))
    front = F.when(rule.startswith("||"), r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?").when(rule.startswith("|"), "^").otherwise("")
    regex = F.concat(F.lit("(?s)"), front, body, F.when(rule.endswith("|"), r"\z").otherwise(""))
    found = F.regexp_extract_all(rule, F.lit("(?<=[^a-z0-9*])([a-z0-9]+)(?=[^a-z0-9*])"), 1)
    return patterns.select("rule", "rule_verdict", regex.alias("regex"), F.when(F.size(found) > 0, F.array_distinct(found)).otherwise(F.array(F.lit(""))).alias("tokens"))


def index_rules(rules: DataFrame, subjects: DataFrame) -> DataFrame:
    """rules filed under the rarest of their tokens. subjects: own_tokens of each url."""
    named = rules.distinct().withColumn("token", F.explode("tokens"))
    seen = subjects.select(F.explode("own_tokens").alias("token")).join(named.select("token").distinct(), "token").groupBy("token").agg(F.count("*").alias("uses"))
    best = F.min(F.struct(F.coalesce("uses", F.lit(0)).alias("uses"), F.negative(F.length("token")).alias("shortness"), "token")).alias("best")
    return named.join(seen, "token", "left").groupBy("rule", "rule_verdict", "regex").agg(best).select("rule", "rule_verdict", "regex", F.col("best.token").alias("token"))


def best_from_map(index: list, own_tokens: Column, subject: Column) -> Column:
    """The winning rule as WINNER, from a literal map of the bounded index."""
    filed: dict[str, list] = {}
    for r in index:
        filed.setdefault(r["token"], []).append(r)
    entry = lambda r: F.struct(F.lit(-len(r["rule"])).alias("n"), F.lit(r["rule"]).alias("rule"), F.lit(r["rule_verdict"]).alias("rule_verdict"), F.lit(r["regex"]).alias("regex"))
    pairs = [x for token, rules in sorted(filed.items()) for x in (F.lit(token), F.array(*map(entry, rules)))]
    fetched = F.flatten(F.transform(F.filter(own_tokens, lambda t: t.isin(*filed)), lambda t: F.element_at(F.create_map(*pairs), t)))
    best = F.array_min(F.filter(fetched, lambda r: F.rlike(subject, r["regex"])))
    return F.struct(best["n"].alias("n"), best["rule"].alias("rule"), best["rule_verdict"].alias("rule_verdict"))


def with_best(urls: DataFrame, rules: DataFrame, subject: str, own_tokens: Column, name: str) -> DataFrame:
    """urls with the WINNER of each row as column `name`.

    Up to LITERAL_RULES rules there is no shuffle of urls. Beyond, distinct subjects are joined with the index on the token, their
    winners written, and joined back, where adaptive execution can split a hot subject.
    """
    index = durable(index_rules(rules, urls.select(own_tokens.alias("own_tokens"))))
    small = index.limit(LITERAL_RULES + 1).collect()
    if not small:
        return urls.withColumn(name, F.lit(None).cast(WINNER))
    if len(small) <= LITERAL_RULES:
        return urls.withColumn(name, best_from_map(small, own_tokens, F.col(subject)))
    candidates = urls.groupBy(subject).agg(F.first(own_tokens).alias("own_tokens")).select(subject, F.explode("own_tokens").alias("token")).join(index, "token")
    winner = F.min(F.struct(F.negative(F.length("rule")).alias("n"), "rule", "rule_verdict")).alias(name)
    return urls.join(durable(candidates.filter(F.rlike(subject, F.col("regex"))).groupBy(subject).agg(winner)), subject, "left")


def judge_urls(pages: DataFrame, rules: DataFrame, patterns: DataFrame | None = None, id_column: str = "page_id", url_column: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """id, host, path, rule, verdict and pattern (the pattern rule that decided, else null) of each row of pages."""
    url = F.col(url_column).cast("string")
    parsed = pages.select(F.col(id_column).alias("page_id"), host_column(url).alias("host"), path_column(url).alias("path"), F.coalesce(F.translate(url, UPPER, LOWER), F.lit("")).alias("whole"))
    parsed = parsed.withColumn("place", F.concat("host", "path"))
    judged = with_best(parsed, compiled_hosts(rules), "place", host_tokens(F.col("host"), F.col("path")), "best")
    if patterns is not None:
        judged = with_best(judged, compiled_patterns(patterns), "whole", url_tokens(F.col("whole")), "other")
    else:
        judged = judged.withColumn("other", F.lit(None).cast(WINNER))
    pattern = F.when(F.col("best.rule").isNull(), F.col("other.rule"))
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", "other.rule_verdict", F.lit(default)).alias("verdict"), pattern.alias("pattern"))


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS whole,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, whole, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(rule, rh, rp, v) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
o(pattern, regex, ov) AS (VALUES
  ('||ads-track.', '^[a-z][a-z0-9+.-]*://([^/?#]*[.])?ads-track[.]', 'block'), ('||ads.', '^[a-z][a-z0-9+.-]*://([^/?#]*[.])?ads[.]', 'block'),
  ('||adserver*.', '^[a-z][a-z0-9+.-]*://([^/?#]*[.])?adserver.*[.]', 'block'), ('||doubleclick.', '^[a-z][a-z0-9+.-]*://([^/?#]*[.])?doubleclick[.]', 'block'),
  ('^casino^', '([^a-z0-9_.%-]|$)casino([^a-z0-9_.%-]|$)', 'block'), ('^poker^*bonus', '([^a-z0-9_.%-]|$)poker([^a-z0-9_.%-]|$).*bonus', 'block'),
  ('^porn^', '([^a-z0-9_.%-]|$)porn([^a-z0-9_.%-]|$)', 'block'), ('^xxx^', '([^a-z0-9_.%-]|$)xxx([^a-z0-9_.%-]|$)', 'block'),
  ('^casino^*^history^', '([^a-z0-9_.%-]|$)casino([^a-z0-9_.%-]|$).*([^a-z0-9_.%-]|$)history([^a-z0-9_.%-]|$)', 'allow'),
  ('/cgi-bin/', '/cgi-bin/', 'block'), ('/wp-login.', '/wp-login[.]', 'block'), ('/cart^', '/cart([^a-z0-9_.%-]|$)', 'block'), ('/checkout^', '/checkout([^a-z0-9_.%-]|$)', 'block'),
  ('^jsessionid=', '([^a-z0-9_.%-]|$)jsessionid=', 'block'), ('^phpsessid=', '([^a-z0-9_.%-]|$)phpsessid=', 'block'),
  ('.apk|', '[.]apk$', 'block'), ('.exe|', '[.]exe$', 'block'), ('.zip|', '[.]zip$', 'block'), ('|ftp://', '^ftp://', 'block')),
f AS (
  SELECT h.page_id, h.host, h.path, h.whole, r.rule, r.v,
         row_number() OVER (PARTITION BY h.page_id ORDER BY length(r.rule) DESC NULLS LAST, r.rule) AS rn
  FROM h LEFT JOIN r ON (h.host = r.rh OR ends_with(h.host, '.' || r.rh)) AND starts_with(h.path, r.rp)),
w AS (SELECT * FROM f WHERE rn = 1),
m AS (
  SELECT w.*, o.pattern, o.ov, row_number() OVER (PARTITION BY w.page_id ORDER BY length(o.pattern) DESC NULLS LAST, o.pattern) AS pn
  FROM w LEFT JOIN o ON w.rule IS NULL AND regexp_matches(w.whole, '(?s)' || o.regex))
SELECT page_id, host, path, rule, coalesce(v, ov, 'allow') AS verdict, pattern FROM m WHERE pn = 1
"""
