"""URL rules, fetched by their rarest literal token."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """verdict is 'allow' or 'block'. pattern is a Java regular expression that is searched for in `host + path` of a
    host rule and in the whole url of a pattern rule. literals are lower-case runs of [a-z0-9] that stand as whole
    tokens in whatever the pattern matches; of host rules, name is what is reported and its length the priority."""

    name: str
    verdict: str
    pattern: str
    literals: tuple[str, ...]
    host_rule: bool


def host_rule(verdict: str, rule: str) -> Rule:
    """A rule `host/path`: fits the host and all its subdomains if the url's path starts with the rule's."""
    host, _, path = rule.partition("/")
    host, path = host.lower(), "/" + path
    quoted = re.sub(r"([^\w/-])", r"\\\1", host + path)
    # the path's last token may go on in the url, so it is no whole token unless something closes it
    tokens = re.findall(r"[a-z0-9]+(?=[^A-Za-z0-9])", re.sub("[A-Z]", lambda m: m[0].lower(), host + path))
    return Rule(rule, verdict, rf"^(?:[^/]*\.)?{quoted}", tuple(dict.fromkeys(tokens)), True)


def pattern_rule(name: str, verdict: str, pattern: str, literals: Sequence[str]) -> Rule:
    """A pattern with the tokens that every url it matches holds as whole tokens."""
    if not literals:
        raise ValueError(f"rule {name} has no literal token to be indexed by")
    return Rule(name, verdict, pattern, tuple(literals), False)


#: What is judged where no host rule fits: single words that, as a whole token of a url, mark advertising, gambling,
#: adult or account pages. Lists like this are data; callers give their own.
_WORDS = "ads adserver advert banner casino poker betting porn xxx nude escort login signin signup logout cart checkout".split()
WORD_PATTERNS = tuple(pattern_rule(w, "block", rf"(?i)(?<![a-z0-9]){w}(?![a-z0-9])", [w]) for w in _WORDS)
#: Patterns of several tokens, which only their regular expression decides: the tokens alone, in another order or place,
#: say nothing. Any of the literals would do to fetch a pattern; the rarest one does.
SHAPE_PATTERNS = (
    pattern_rule("tag-page", "block", r"(?i)/tag/[^/?#]+/page/[0-9]+", ["tag", "page"]),
    pattern_rule("calendar-day", "block", r"(?i)/calendar/(19|20)[0-9][0-9]/[0-9][0-9]?(/|$)", ["calendar"]),
    pattern_rule("site-search", "block", r"(?i)/search/?[?]([^#]*&)?(q|query)=[^&#]", ["search"]),
    pattern_rule("print-view", "block", r"(?i)[?&]print=(1|true|yes)(&|#|$)", ["print"]),
    pattern_rule("campaign", "block", r"(?i)[?&]utm_source=[^&#]*&([^#]*&)?utm_medium=", ["utm", "source", "medium"]),
    pattern_rule("session-id", "block", r"(?i)[?&;]phpsessid=[0-9a-z]+", ["phpsessid"]),
    pattern_rule("numbered-list", "block", r"(?i)/(item|list)/[0-9]+/page/[0-9][0-9][0-9]", ["page"]),
    pattern_rule("article", "allow", r"(?i)^[a-z]+://[^/?#]+/article/[0-9][0-9][0-9][0-9]/[a-z0-9-]+[.]html$", ["article", "html"]),
)
DEFAULT_PATTERNS = (*WORD_PATTERNS, *SHAPE_PATTERNS)


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; empty if there is none."""
    rest = F.substring_index(F.substring_index(F.substring_index(_rest(url), "/", 1), "?", 1), "#", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to '?', '#' or the end."""
    before = F.substring_index(F.substring_index(_rest(url), "?", 1), "#", 1)
    return F.when(F.instr(before, "/") > 0, F.substr(before, F.instr(before, "/"))).otherwise("")


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def _tokens(text: Column) -> Column:
    """Distinct lower-case runs of [a-z0-9]."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.array_remove(F.split(low, "[^a-z0-9]+"), ""))


def rule_index(urls: DataFrame, rules: Sequence[Rule], url_col: str = "url") -> DataFrame:
    """Each rule with the literal token that the fewest urls of this corpus hold: (token, rule columns).

    Frequencies are counted over all urls, for the rules' tokens only; ties go to the first token by code point.
    """
    spark = urls.sparkSession
    table = spark.createDataFrame([(i, r.name, r.verdict, r.pattern, list(r.literals), r.host_rule) for i, r in enumerate(rules)], "rule_no int, name string, rule_verdict string, pattern string, literals array<string>, host_rule boolean")
    exploded = table.select("rule_no", "name", "rule_verdict", "pattern", "host_rule", F.explode("literals").alias("token"))
    wanted = exploded.select("token").distinct()
    seen = urls.select(F.explode(_tokens(F.col(url_col))).alias("token")).join(wanted, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n_urls"))
    best = exploded.join(seen, "token", "left").groupBy("rule_no").agg(F.min(F.struct(F.coalesce("n_urls", F.lit(0)).alias("n_urls"), F.col("token"))).alias("rarest"))
    return table.drop("literals").join(best, "rule_no").select("rule_no", "name", "rule_verdict", "pattern", "host_rule", F.col("rarest.token").alias("token"))


def judge_urls(pages: DataFrame, rules: Sequence[Rule], *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of pages: id, host, path, rule, verdict, pattern, n_candidates.

    A url's tokens fetch the rules that are indexed by one of them; only those run their regular expression. The
    longest host rule that fits decides (`rule`, ties by code point); else a pattern rule does (block before allow;
    `pattern` is its name, the first by code point); else the default. Verdicts are worked out once per distinct
    url and joined back, so repeated rows and ids, null ids and clashing column names do no harm; a null url, or one
    without '://', has empty host and path and gets the default. Rules without any whole literal token (such as a
    bare top-level prefix 'x') are refused by `pattern_rule`; host rules always have their host's tokens.
    The rules' table is joined, not broadcast by hand: Catalyst broadcasts it below its threshold and shuffles it above.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    urls = rows.where(F.col("url").isNotNull()).select("url").distinct().select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    index = rule_index(rows.where(F.col("url").isNotNull()), rules)
    candidates = urls.select("url", "host", "path", F.explode(_tokens(F.col("url"))).alias("token")).join(index, "token")
    fits = F.when(F.col("host_rule"), F.expr("concat(host, path) rlike pattern")).otherwise(F.expr("url rlike pattern"))
    hosts, block, allow = (F.when(F.col("fits") & c, x) for c, x in (
        (F.col("host_rule"), F.struct(F.length("name").alias("n"), F.col("name"), F.col("rule_verdict"))),
        (~F.col("host_rule") & (F.col("rule_verdict") == "block"), F.col("name")),
        (~F.col("host_rule") & (F.col("rule_verdict") == "allow"), F.col("name")),
    ))
    judged = candidates.withColumn("fits", fits).groupBy("url").agg(F.max(hosts).alias("best"), F.min(block).alias("block"), F.min(allow).alias("allow"), F.count(F.lit(1)).alias("n"))
    verdict = F.coalesce(F.col("best.rule_verdict"), F.when(F.col("block").isNotNull(), "block"), F.when(F.col("allow").isNotNull(), "allow"), F.lit(default))
    return rows.join(judged, "url", "left").select(
        F.col("id").alias(id_col), F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), F.coalesce(path_of(F.col("url")), F.lit("")).alias("path"), F.col("best.name").alias("rule"), verdict.alias("verdict"),
        F.when(F.col("best").isNull(), F.coalesce("block", "allow")).alias("pattern"), F.coalesce("n", F.lit(0)).alias("n_candidates"),
    )
