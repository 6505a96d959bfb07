"""URL filters: rules found by their rarest literal token, regular expressions only for those.

A rule of either kind holds literal tokens, runs of ``[a-z0-9%]`` that stand between other
characters wherever the rule fits. Each rule is filed under the one of them that the fewest URLs
hold. A URL's own tokens then fetch its candidate rules, and only these run their expression. A rule
without such a token is a candidate of every URL.

* *Host rules* name a host and the beginning of a path (``example.org/es/``). They fit the host and
  its subdomains; of several the longest decides, then the one with the longer host, then the
  smaller text.
* *Patterns* decide where no host rule fits. They are matched against the whole URL, A-Z
  lower-cased: ``*`` is anything, ``^`` a character that is no letter, digit or ``_-.%``, or the end;
  ``||`` begins at a label of the host, ``|`` is the begin or the end of the URL, ``@@`` in front
  makes it an exception. A URL is blocked by a pattern unless an exception fits too, and allowed
  where none fits.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from routelens.llm.common import written

#: Host rules, by verdict.
HOST_RULES = (
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
    ("allow", "com/fr/"), ("block", "com/de/"),
)
#: Patterns for advertisement and spam hosts, pages without prose, and files.
PATTERNS = (
    "||spam-farm.", "-pills.", "||casino.", "^casino^", "^porn^", "^xxx^", "^viagra^", "||adserver.",
    "||ads.", "^ads^", "^login^", "^signin^", "^logout^", "^cart^", "^checkout^", "^wp-admin^",
    "^wp-login.php^", "^cgi-bin^", "^phpsessid^", "^sessionid^", "?replytocom=", ".jpg|", ".png|",
    ".gif|", ".zip|", ".exe|", ".mp4|", "^download^*.pdf|", "^tag^*^feed^", "@@||docs.", "@@^wiki^",
)

_TOKEN = re.compile(r"[a-z0-9%]+")
_SEPARATOR = r"(?:[^a-z0-9_.%-]|$)"


class Rule(NamedTuple):
    """``text`` as given, ``verdict`` allow or block, ``is_host``, the expression, usable tokens."""

    text: str
    verdict: str
    is_host: bool
    expression: str
    tokens: tuple[str, ...]


def _tokens(text: str, bounded: str) -> tuple[str, ...]:
    """The tokens of a rule that stand between characters of which ``bounded`` says so."""
    found = []
    for match in _TOKEN.finditer(text.lower()):
        before, after = bounded[match.start()], bounded[match.end() + 1]
        if before == after == "y":
            found.append(match.group())
    return tuple(dict.fromkeys(found))


def host_rule(verdict: str, text: str) -> Rule:
    """A rule on host and beginning of path. It is matched against host and path."""
    host = text.partition("/")[0].lower()
    path = text[len(host):]
    if not path:
        raise ValueError(f"{text!r} has no path; give at least '/'")
    # Every character that is no part of a token bounds one; so does the begin, not the end.
    bounded = "y" + "".join("n" if _TOKEN.fullmatch(c) else "y" for c in text.lower()) + "n"
    return Rule(text, verdict, True, rf"\A(?:[^/]*\.)?{re.escape(host + path)}", _tokens(text, bounded))


def pattern_rule(text: str) -> Rule:
    """A pattern (see above). It is matched against the whole URL, A-Z lower-cased."""
    body = text.removeprefix("@@").lower()
    verdict = "allow" if text.startswith("@@") else "block"
    start, bounded = "", "n"
    if body.startswith("||"):
        body, start, bounded = body[2:], r"\A[^:/?#]*://(?:[^/?#]*\.)?", "y"
    elif body.startswith("|"):
        body, start, bounded = body[1:], r"\A", "y"
    end, last = "", "n"
    if body.endswith("|"):
        body, end, last = body[:-1], r"\Z", "y"
    if not body.replace("*", ""):
        raise ValueError(f"{text!r} names nothing")
    bounded += "".join("n" if c == "*" or _TOKEN.fullmatch(c) else "y" for c in body) + last
    middle = "".join({"*": "(?s:.*)", "^": _SEPARATOR.replace("$", r"\Z")}.get(c, re.escape(c)) for c in body)
    return Rule(text, verdict, False, start + middle + end, _tokens(body, bounded))


def rules_of(host_rules: Iterable[tuple[str, str]], patterns: Iterable[str]) -> list[Rule]:
    return [*(host_rule(*rule) for rule in host_rules), *map(pattern_rule, patterns)]


def lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def token_counts(pages: DataFrame, rules: list[Rule]) -> dict[str, int]:
    """In how many rows' URLs each token of a rule stands; at most as many entries as there are tokens.

    Tokens of no rule are dropped before the shuffle, and what is left is counted per task first.
    """
    wanted = sorted({token for rule in rules for token in rule.tokens})
    found = pages.select(F.explode(F.array_distinct(_url_tokens(F.col("url")))).alias("token"))
    # The rules are given by the caller, one by one: the list is no larger than theirs.
    few = pages.sparkSession.createDataFrame([(token,) for token in wanted], "token string")
    counted = found.join(F.broadcast(few), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    return {token: 0 for token in wanted} | {row.token: row.n for row in counted.collect()}


def _url_tokens(url: Column) -> Column:
    return F.regexp_extract_all(lower(url), F.lit(f"({_TOKEN.pattern})"), 1)


def filed(rules: list[Rule], counts: dict[str, int]) -> dict[str, list[int]]:
    """Numbers of the rules by the token each is filed under: its rarest, '' if it has none."""
    index: dict[str, list[int]] = {}
    for number, rule in enumerate(rules):
        token = min(rule.tokens, key=lambda token: (counts[token], token), default="")
        index.setdefault(token, []).append(number)
    return index


@lru_cache(maxsize=4096)
def _compiled(expression: str) -> re.Pattern:
    return re.compile(expression)


def _fits(rule: Rule, host_and_path: str, url: str) -> bool:
    return _compiled(rule.expression).search(host_and_path if rule.is_host else url) is not None


def _order(rule: Rule) -> tuple:
    """Smaller for the host rule that decides."""
    return -len(rule.text), -rule.text.find("/"), rule.text


def _decide(fitting: list[Rule]) -> tuple[str | None, str | None, str]:
    """Rule, pattern and verdict, from the rules that fit."""
    rule = min((r for r in fitting if r.is_host), key=_order, default=None)
    # An exception goes before what it excepts.
    pattern = min((r for r in fitting if not r.is_host), key=lambda r: (r.verdict, r.text), default=None)
    return (rule and rule.text, pattern and pattern.text,
            rule.verdict if rule else pattern.verdict if pattern else "allow")


_JUDGED = "rule string, pattern string, verdict string"


def judge_urls(pages: DataFrame, host_rules: Iterable[tuple[str, str]] = HOST_RULES,
               patterns: Iterable[str] = PATTERNS, most_held: int = 200_000) -> DataFrame:
    """(page_id, host, path, rule, pattern, verdict), one row for each row of ``pages`` (page_id, url).

    ``host_rules`` are (verdict, host and path) and decide first, ``patterns`` decide the rest; see
    the module. ``rule`` is the host rule that decides, else NULL; ``pattern`` the pattern that fits,
    exceptions first and then by text, else NULL, and is given next to a rule too.

    Up to ``most_held`` rules the index goes to every task and no row is shuffled. With more, tokens
    and index are joined, the index in several copies, so that a token which many URLs hold is
    spread over as many tasks. Both give the same.

    A NULL URL, or one without ``://``, has an empty host and path; patterns see it as its text,
    NULL as an empty one. NULL ids, repeated ids and repeated rows each give a row. Further columns
    of ``pages`` are not read.
    """
    rules = rules_of(host_rules, patterns)
    url = F.coalesce(lower(F.col("url")), F.lit(""))
    rows = pages.select("page_id", "url", url.alias("lowered"), host_of(F.col("url")).alias("host"),
                        path_of(F.col("url")).alias("path"))
    index = filed(rules, token_counts(pages, rules))
    judged = _by_index(rows, rules, index) if len(rules) <= most_held else _by_join(rows, rules, index)
    return judged.select("page_id", "host", "path", "rule", "pattern", "verdict")


def _by_index(rows: DataFrame, rules: list[Rule], index: dict[str, list[int]]) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast((rules, index))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, index = held.value
        always = index.get("", [])
        for batch in batches:
            judged = []
            for url, host, path in zip(*(batch.column(name).to_pylist() for name in ("lowered", "host", "path")),
                                       strict=True):
                numbers = list(always)
                for token in set(_TOKEN.findall(url)):
                    numbers += index.get(token, ())
                judged.append(_decide([rules[n] for n in numbers if _fits(rules[n], host + path, url)]))
            columns = list(zip(*judged, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("host"), batch.column("path"),
                 *[pa.array(column, pa.string()) for column in columns]],
                names=["page_id", "host", "path", "rule", "pattern", "verdict"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.select("page_id", "lowered", "host", "path").mapInArrow(
        run, f"page_id {kind}, host string, path string, {_JUDGED}")


def _by_join(rows: DataFrame, rules: list[Rule], index: dict[str, list[int]], copies: int = 16) -> DataFrame:
    spark = rows.sparkSession
    table = written(spark.createDataFrame(
        [(token, n, *rules[n][:4]) for token, numbers in index.items() for n in numbers],
        "token string, number long, text string, rule_verdict string, is_host boolean, expression string"))
    table = table.select("*", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()))
    candidates = (
        rows.select("row", "lowered", F.concat("host", "path").alias("place"), F.explode(F.array_union(
            _url_tokens(F.col("lowered")), F.array(F.lit("")))).alias("token"))
        .withColumn("copy", F.pmod(F.xxhash64("row"), F.lit(copies)).cast("int"))
        .join(table, ["token", "copy"]))

    @arrow_udf("boolean")
    def fits(expressions: pa.Array, texts: pa.Array) -> pa.Array:
        return pa.array([_compiled(e).search(text) is not None for e, text in zip(
            expressions.to_pylist(), texts.to_pylist(), strict=True)], pa.bool_())

    fitting = candidates.where(fits("expression", F.when(F.col("is_host"), F.col("place")).otherwise(
        F.col("lowered"))))
    found = F.struct("text", F.col("rule_verdict").alias("verdict"))
    order = F.struct(-F.length("text"), -F.instr("text", "/"), "text")
    best = fitting.groupBy("row").agg(
        F.min_by(F.when(F.col("is_host"), found), F.when(F.col("is_host"), order)).alias("r"),
        F.min_by(F.when(~F.col("is_host"), found), F.when(~F.col("is_host"), F.struct(
            "rule_verdict", "text"))).alias("p"))
    return rows.join(best, "row", "left").select(
        "page_id", "host", "path", F.col("r.text").alias("rule"), F.col("p.text").alias("pattern"),
        F.coalesce("r.verdict", "p.verdict", F.lit("allow")).alias("verdict"))
