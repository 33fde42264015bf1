"""URL filters: pattern rules filed under their rarest literal token."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sliceweave.session import materialize

#: Up to so many rules are sent to every task; more are joined by their token like any other table.
SENT_RULES = 50_000


@dataclass(frozen=True)
class HostRule:
    """``action`` for a host with its subdomains, where the path starts with ``path``."""

    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        quoted = lambda s: "".join(c if c.isalnum() or c in "/-_" else "\\" + c for c in s)
        return rf"^(?:[^/]*\.)?{quoted(self.host)}{quoted(self.path)}"

    @property
    def literal(self) -> str:
        # the host is whole tokens up to its start; the path's last token may go on in the url
        path = self.path if not self.path or not self.path[-1].isalnum() else self.path.rstrip("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
        return self.host + path


@dataclass(frozen=True)
class PatternRule:
    """``action`` for an address (host, path and query) in which ``pattern`` is found; ``literal`` has tokens that each such
    address holds whole."""

    action: str
    pattern: str
    literal: str


# Fixed values of the query.
HOST_RULES = (HostRule("block", "net", "/"), HostRule("allow", "example.net", "/en/"), HostRule("block", "example.com", "/de/"),
              HostRule("allow", "org", "/fr/"))
# for addresses that no host rule judges: what is no article, or comes from an advertiser
PATTERN_RULES = (
    PatternRule("block", r"/login(?:[/?.]|$)", "login"), PatternRule("block", r"/cart(?:[/?.]|$)", "cart"),
    PatternRule("block", r"(?:^|\.)casino[.-]", "casino"), PatternRule("block", r"(?:^|\.)ads\.[^/]*/", "ads"),
    PatternRule("block", r"[?&]replytocom=", "replytocom"), PatternRule("allow", r"/archive/[0-9]{4}/", "archive"),
)


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda t: t != "")


def judge_urls(pages: DataFrame, host_rules: Sequence[HostRule] = HOST_RULES, pattern_rules: Sequence[PatternRule] = PATTERN_RULES,
               default: str = "allow", url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule (the host rule that decides, else null) and verdict.

    Among the host rules that fit, the longest decides (ties: the smaller text). Else a block pattern decides over an allow
    pattern, and ``default`` where none fits. A null address, or one without ``://``, has an empty host and path, fits no
    rule and gets the default.

    Every distinct address is judged once: its tokens fetch the rules filed under them, and only those patterns run. A rule
    is filed under that token of its literal which the fewest addresses hold. A rule without any token is filed under an
    empty one that all addresses have. Columns named like the added ones are replaced; an empty table gives no rows.
    """
    spark = pages.sparkSession
    added = ("host", "path", "rule", "verdict")
    base = pages.drop(*[c for c in added if c != url_col])
    urls = materialize(base.select(F.col(url_col).alias("_url")).filter(F.col("_url").contains("://")).distinct())
    whole = F.concat(host_of(F.col("_url")), F.regexp_extract("_url", r"(?s)^.*?://[^/?#]*([^#]*)", 1))
    split = urls.select("_url", whole.alias("_whole"), F.concat(host_of(F.col("_url")), path_of(F.col("_url"))).alias("_place"))
    held = split.select("*", F.explode(F.array_append(F.array_distinct(tokens_of(F.col("_whole"))), F.lit(""))).alias("token"))

    rows = [(i, "host", r.action, r.name, r.pattern, r.literal) for i, r in enumerate(host_rules)]
    rows += [(len(rows) + i, "pattern", r.action, None, r.pattern, r.literal) for i, r in enumerate(pattern_rules)]
    rules = spark.createDataFrame(rows, "id long, kind string, action string, name string, pattern string, literal string")
    filed = rules.withColumn("token", F.explode(F.array_append(F.array_distinct(tokens_of(F.col("literal"))), F.lit(""))))
    counts = held.join(F.broadcast(filed.select("token").distinct()) if len(rows) <= SENT_RULES else filed.select("token").distinct(), "token", "left_semi")
    counts = counts.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    # the empty token is the last choice
    order = F.struct((F.col("token") == "").alias("none"), F.coalesce("n", F.lit(0)).alias("n"), "token")
    index = filed.join(counts, "token", "left").groupBy("id", "kind", "action", "name", "pattern").agg(F.min(order).alias("o"))
    index = materialize(index.select("kind", "action", "name", "pattern", F.col("o.token").alias("token")))

    fetched = held.join(F.broadcast(index) if len(rows) <= SENT_RULES else index, "token")
    fits = fetched.filter(F.expr("rlike(case when kind = 'host' then _place else _whole end, pattern)"))
    # the longest host rule, ties to the smaller text; among patterns "block" is the greater text
    rank = F.struct((-F.length("name")).alias("n"), F.col("name"), F.col("action"))
    judged = fits.groupBy("_url").agg(F.min(F.when(F.col("kind") == "host", rank)).alias("_host"),
                                      F.max(F.when(F.col("kind") == "pattern", F.col("action"))).alias("_pattern"))
    joined = base.join(judged, base[url_col] == judged["_url"], "left")
    return joined.select(*[base[c] for c in base.columns], host_of(base[url_col]).alias("host"), path_of(base[url_col]).alias("path"),
                         F.col("_host.name").alias("rule"), F.coalesce("_host.action", "_pattern", F.lit(default)).alias("verdict"))
