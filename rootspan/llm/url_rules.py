"""URL verdicts from pattern rules that are indexed by their rarest literal token. DataFrame operations only.

A rule is a regular expression over host and path together, with the literal tokens that any match
must contain: groups, of each of which it holds one token at least, so alternatives are a group. The corpus says how often each of
those tokens occurs in URLs; a rule is filed under all tokens of its rarest group. A URL's own tokens fetch the rules filed under them, and
only those run. Rules without such a token, whose host is in another script say, are filed under the empty token, which every URL then has;
of the rules here none is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rootspan.scratch import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN_BREAK = "[^a-z0-9]+"
RULES = "rule string, action string, pattern string, literals array<array<string>>, rank int"

#: Fixed by contract: (action, host, path); a rule holds for the host and all subdomains, for paths that start so.
HOST_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

#: The method's own patterns over host and path: (name, pattern, groups of literal tokens). Patterns hold in any case.
PATTERN_RULES = [
    ("ad-server", r"^(?:[^/]*\.)?ads?[0-9]*\.[^/]+/(?:.*[^a-z0-9])?(?:banners?|clicks?|impressions?)(?:$|[^a-z0-9])", [["banner", "banners", "click", "clicks", "impression", "impressions"]]),
    ("session-path", r"/(?:cgi-bin|wp-admin)/", [["cgi", "wp"], ["bin", "admin"]]),
    ("tracking-pixel", r"/(?:pixel|beacon|track(?:ing)?)[0-9]*\.(?:gif|png)$", [["gif", "png"]]),
    ("cheap-pharmacy", r"(?:^|[^a-z0-9])(?:cheap|buy|order)[-_]?(?:online)?[-_](?:pills|meds|pharmacy)(?:$|[^a-z0-9])", [["pills", "meds", "pharmacy"]]),
    ("gambling-offer", r"(?:^|[^a-z0-9])(?:bingo|casino|jackpot|poker|roulette|slots)[^a-z0-9](?:.*[^a-z0-9])?(?:bets?|bonus|deposit|freespins|jackpot|spins)(?:$|[^a-z0-9])", [["bingo", "casino", "jackpot", "poker", "roulette", "slots"], ["bet", "bets", "bonus", "deposit", "freespins", "jackpot", "spins"]]),
    ("payday-loan", r"(?:^|[^a-z0-9])payday[^a-z0-9](?:.*[^a-z0-9])?(?:advance|cash|loans?)(?:$|[^a-z0-9])", [["payday"], ["advance", "cash", "loan", "loans"]]),
    ("escort-service", r"(?:^|[^a-z0-9])escorts?[^a-z0-9](?:.*[^a-z0-9])?(?:agency|girls|models|vip)(?:$|[^a-z0-9])", [["escort", "escorts"], ["agency", "girls", "models", "vip"]]),
    ("download-crack", r"(?:^|[^a-z0-9])(?:free[-_])?(?:download|torrent)[^a-z0-9](?:.*[^a-z0-9])?(?:crack|repack|serial|dvdrip)(?:$|[^a-z0-9])", [["download", "torrent"], ["crack", "repack", "serial", "dvdrip"]]),
]
#: And words that stand for nothing else, as whole tokens of host or path.
BLOCKED_WORDS = ["adserver", "camgirls", "clickbait", "doubleclick", "keygen", "porn", "viagra", "warez", "xxx"]


def host_of(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From after the host up to ``?``, ``#`` or the end; empty if none."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _quoted(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\.\[\]{}()*+?^$|])", r"\\$1")


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.translate(text, UPPER, LOWER), TOKEN_BREAK), lambda t: t != ""))


def host_rules(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (action, host, path prefix) in the common form; among fitting rules the longest host and path wins.

    The last token of a path prefix may go on in a URL, so only those that a break ends count as literal.
    """
    df = spark.createDataFrame(rules, "action string, host string, path string")
    host = F.translate("host", UPPER, LOWER)
    whole = F.regexp_replace(F.concat(host, "path"), "[A-Za-z0-9]+$", "")
    pattern = F.concat(F.lit(r"^(?:[^/]*\.)?"), _quoted(host), _quoted(F.col("path")))
    name = F.concat(host, "path")
    return df.select(name.alias("rule"), "action", pattern.alias("pattern"), F.transform(_tokens(whole), lambda t: F.array(t)).alias("literals"), (F.lit(1_000_000) + F.length(name)).cast("int").alias("rank"))


def word_rules(spark: SparkSession, words: list[str]) -> DataFrame:
    """Rules that block a URL with one of ``words`` as a token; host rules go before them."""
    df = spark.createDataFrame([(w,) for w in words], "word string")
    pattern = F.concat(F.lit("(?i)(?:^|[^a-z0-9])"), _quoted(F.col("word")), F.lit("(?:$|[^a-z0-9])"))
    return df.select(F.col("word").alias("rule"), F.lit("block").alias("action"), pattern.alias("pattern"), F.array(F.array(F.lower("word"))).alias("literals"), F.length("word").alias("rank"))


def pattern_rules(spark: SparkSession, rules: list[tuple[str, str, list[list[str]]]]) -> DataFrame:
    """Patterns (name, regular expression, groups of literal tokens) that block a URL; host rules go before them."""
    df = spark.createDataFrame(rules, "rule string, regex string, literals array<array<string>>")
    return df.select("rule", F.lit("block").alias("action"), F.concat(F.lit("(?is)"), "regex").alias("pattern"), "literals", F.length("rule").alias("rank"))


def rule_index(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """``rules`` with ``token``, a row for each token of the group that the fewest of ``urls`` (host, path) contain; '' for a rule without any."""
    seen = urls.select(F.explode(_tokens(F.concat("host", "path"))).alias("token"))
    own = ["rule", "action", "pattern", "rank"]
    groups = F.when(F.size("literals") > 0, F.col("literals")).otherwise(F.array(F.array(F.lit(""))))
    literal = rules.select(*own, F.posexplode(groups).alias("part", "tokens")).select(*own, "part", F.explode("tokens").alias("token"))
    wanted = materialize(literal.select("token").distinct(), "literals")
    often = seen.join(wanted, "token").groupBy("token").count()
    counted = literal.join(often, "token", "left").groupBy(*own, "part").agg(F.sum(F.coalesce("count", F.lit(0))).alias("count"), F.sort_array(F.collect_set("token")).alias("tokens"))
    filed = counted.groupBy(*own).agg(F.min(F.struct("count", "tokens")).alias("least"))
    return filed.select(*own, F.explode("least.tokens").alias("token"))


def judge_urls(pages: DataFrame, rules: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict, pattern_rule`` for every row of ``pages``.

    rule: the host rule that decided, or null; then verdict is that of the method's patterns
    (pattern_rule names it) or ``default``. Ties in length go to the smaller rule text, and of
    two actions for the same text to block. URLs of any length are judged whole. A null url or one without ``://`` has an empty host and
    path and gets the default. Null and repeated page_ids keep their rows; other columns are not
    read. Rules are joined, so their number is free; the index goes by broadcast only where Spark
    finds its written size below ``spark.sql.autoBroadcastJoinThreshold``. Empty in, empty out.
    """
    spark = pages.sparkSession
    rules = rules if rules is not None else host_rules(spark, HOST_RULES).unionByName(word_rules(spark, BLOCKED_WORDS)).unionByName(pattern_rules(spark, PATTERN_RULES))
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = parsed.select("host", "path").distinct()
    index = materialize(rule_index(rules, urls), "rules")
    own = _tokens(F.concat("host", "path"))
    if index.where("token = ''").take(1):
        own = F.concat(own, F.array(F.lit("")))
    fetched = urls.select("host", "path", F.explode(own).alias("token")).join(index, "token")
    fits = fetched.where(F.expr("concat(host, path) rlike pattern"))
    by_size = F.struct((-F.col("rank")).alias("o"), F.col("rule").alias("rule"), F.when(F.col("action") == "block", 0).otherwise(1).alias("a"), F.col("action").alias("action"), F.col("rank").alias("rank"))
    best = fits.groupBy("host", "path").agg(F.min(by_size).alias("best"))
    found = parsed.join(best, ["host", "path"], "left")
    by_host = F.col("best.rank") >= 1_000_000
    return found.select(
        "page_id", "host", "path", F.when(by_host, F.col("best.rule")).alias("rule"),
        F.coalesce("best.action", F.lit(default)).alias("verdict"), F.when(~by_host, F.col("best.rule")).alias("pattern_rule"),
    )


ORACLE_SQL = """
WITH parsed AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(action, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fit AS (
  SELECT DISTINCT host, path, rhost || rpath AS rule, action FROM (SELECT DISTINCT host, path FROM parsed) p, rules
  WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
best AS (SELECT host, path, rule, action FROM fit QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY length(rule) DESC, rule) = 1),
own(name, pattern) AS (VALUES %s),
bad AS (
  SELECT host, path, name FROM (SELECT DISTINCT host, path FROM parsed) p, own WHERE regexp_matches(host || path, pattern, 'is')
  QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY length(name) DESC, name) = 1)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.action, CASE WHEN w.name IS NOT NULL THEN 'block' END, 'allow') AS verdict,
  CASE WHEN b.rule IS NULL THEN w.name END AS pattern_rule
FROM parsed p LEFT JOIN best b ON p.host = b.host AND p.path = b.path LEFT JOIN bad w ON p.host = w.host AND p.path = w.path
""" % ", ".join(f"('{name}', '{pattern}')" for name, pattern in [(w, f"(?:^|[^a-z0-9]){w}(?:$|[^a-z0-9])") for w in BLOCKED_WORDS] + [r[:2] for r in PATTERN_RULES])
