"""URL filters: pattern rules indexed by their rarest literal token (built-in functions only).

A rule is (action, host, path) and fits a host and its subdomains if the path starts with the rule's, or
(action, pattern) with `*` for any characters, matched anywhere in the URL. Each rule becomes one regular
expression. The tokens of all URLs are counted and a rule is filed under its literal token that fewest URLs have, so
a frequent token such as `com` holds a rule only if it has no other. The tokens of a URL fetch the candidate
rules by an equi-join, and only those run their expressions. A rule without a literal token is filed under
the empty token, which every URL has. The best fit is the longest rule, then `block` before `allow`, then the text.

Work is done on distinct URLs, so a URL that a third of the rows share is judged once. The rules are a small
table beside the URLs; Spark broadcasts them by its own size threshold and shuffles otherwise.

Null URLs, and URLs without `://`, have an empty host and path and get no host rule. Empty tables give empty
results. Repeated rows each get their verdict. Other columns of the input are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewren.llm.common import ascii_lower

_PARTS = r"://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    action: str
    host: str = ""
    path: str = ""
    pattern: str = ""

    @property
    def text(self) -> str:
        return self.pattern or self.host + self.path

    @property
    def regex(self) -> str:
        if self.pattern:
            return "(?s)" + ".*".join(map(_quoted, self.pattern.split("*")))
        return r"(?s)^(?:[^/]*\.)?" + _quoted(self.host) + (_quoted(self.path) if self.path else "(?=/|$)")

    @property
    def tokens(self) -> list[str]:
        """Literal tokens that any fitting URL has: runs of letters and digits with a delimiter of the rule on both sides.

        The host of a host rule stands between dots or the ends of the host, so both its ends count as delimiters; the end
        of a path or pattern does not, as the URL may go on.
        """
        text = self.pattern or f".{self.host}{self.path or '/'}"
        return sorted({m[1].lower() for m in re.finditer(r"(?<=[^A-Za-z0-9*])([A-Za-z0-9]+)(?=[^A-Za-z0-9*])", text)})


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9_])", r"\\\1", text) if text.isascii() else re.escape(text)


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def _tokens(url: Column) -> Column:
    found = F.split(F.lower(F.coalesce(url, F.lit(""))), "[^a-z0-9]+")
    return F.array_distinct(F.array_append(found, F.lit("")))


def rule_table(spark: SparkSession, rules: list[Rule], fallback: list[Rule]) -> DataFrame:
    """One row per rule: rule, action, first (false for the fallback rules), on_host, regex, tokens."""
    rows = [(r.text, r.action, first, not r.pattern, r.regex, r.tokens) for part, first in ((rules, True), (fallback, False)) for r in part]
    schema = "rule string, action string, first boolean, on_host boolean, regex string, tokens array<string>"
    return spark.createDataFrame(rows, schema)


def index_rules(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """The rules with the column token instead of tokens: the literal token that fewest of the given distinct URLs have."""
    kept = ["rule", "action", "first", "on_host", "regex"]
    literal = rules.select(*kept, F.explode_outer("tokens").alias("token"))
    seen = urls.select(F.explode(_tokens(F.col("url"))).alias("token"))
    count = (
        seen.join(literal.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n_urls"))
    )
    rarity = F.struct(F.coalesce("n_urls", F.lit(0)), -F.length("token"), "token")
    best = literal.join(count, "token", "left").groupBy(*kept).agg(F.min_by("token", rarity).alias("token"))
    return best.withColumn("token", F.coalesce("token", F.lit("")))


def match_urls(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct URLs of the column url that a rule fits: url, rule and action of the best rule, and the best fallback's action."""
    filed = index_rules(rules, urls)
    subject = F.when(F.col("on_host"), F.concat(host_of(F.col("url")), path_of(F.col("url")))).otherwise(F.col("url"))
    has_host = F.col("url").contains("://") | ~F.col("on_host")
    fits = (
        urls.withColumn("token", F.explode(_tokens(F.col("url"))))
        .join(filed, "token")
        .where(has_host & F.regexp_like(subject, F.col("regex")))
    )
    rank = F.struct(F.length("rule"), F.col("action") == "block", "rule")
    best = F.max_by(F.struct("rule", "action"), F.when(F.col("first"), rank))
    other = F.max_by("action", F.when(~F.col("first"), rank))
    return fits.groupBy("url").agg(best.alias("best"), other.alias("other_action")).select("url", "best.*", "other_action")


def filter_urls(pages: DataFrame, rules: DataFrame, keys: list[str], url: str = "url") -> DataFrame:
    """Every row of pages: keys, host, path, rule, verdict.

    The first rules decide; where none fits, rule is null and the verdict is that of the fallback rules, or allow.
    """
    rows = pages.select(*keys, F.col(url).alias("__url"))
    best = match_urls(rows.select(F.col("__url").alias("url")).where("url is not null").distinct(), rules)
    best = best.select(F.col("url").alias("__url"), F.col("rule").alias("__rule"), "action", "other_action")
    return rows.join(best, "__url", "left").select(
        *[rows[k] for k in keys], host_of(F.col("__url")).alias("host"), path_of(F.col("__url")).alias("path"),
        F.col("__rule").alias("rule"), F.coalesce("action", "other_action", F.lit("allow")).alias("verdict"),
    )
