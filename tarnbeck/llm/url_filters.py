"""Operator 12, URL filters: pattern rules indexed by their rarest literal token.

A rule is a pattern: literal text with `*` for any run of signs, `^` for one separator (or the end), `|` at either end for an
anchor and `||` in front for the start of the host or of one of its labels. Tokens are runs of a-z and 0-9. A token of a
rule that is bounded on both sides must be a whole token of every URL that the rule matches; of these the one that the
fewest URLs hold indexes the rule. A URL's tokens fetch the candidates, and only their regular expressions run on it. Rules
without such a token are candidates of every URL.

The index is built on the driver from the rules (a parameter) and the counts of their own tokens over all URLs, and goes along
as one literal: an array of buckets by the token's crc32, so a look-up does not depend on the number of rules. Judging is
one pass in DataFrame functions, without a shuffle; counting the rules' tokens is another, with partial counts.

The part of a URL after its first `://` is judged, its host with A-Z lower-cased; host rules see the rest as it is, other
patterns see it with A-Z lower-cased. Host rules come before patterns; among each the longest wins, then block, then the
smaller text. Nulls and URLs without `://` have empty host and path and no tokens. Rows that repeat or have null keys are
judged each; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN = "[a-z0-9]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules that one index holds; a longer list is a mistake rather than a literal to send to every task.
MAX_RULES = 100_000


class Rule(NamedTuple):
    text: str
    verdict: str
    #: host rules: text is a host and the beginning of a path
    is_host: bool = False

    @property
    def pattern(self) -> str:
        return f"||{self.text}" if self.is_host else self.text


HOSTS = [Rule("net/", "block", True), Rule("example.net/en/", "allow", True), Rule("example.com/de/", "block", True), Rule("org/fr/", "allow", True)]
#: What the method adds: pages that hold forms, files, sessions and further views of other pages rather than texts.
PATTERNS = [
    Rule("/login^", "block"),
    Rule("/signup^", "block"),
    Rule("/register^", "block"),
    Rule("/cart^", "block"),
    Rule("/checkout^", "block"),
    Rule("/wp-admin/", "block"),
    Rule("/cgi-bin/", "block"),
    Rule("/calendar/*/day/", "block"),
    Rule("/tag/*/page/", "block"),
    Rule("^replytocom=", "block"),
    Rule("^sessionid=", "block"),
    Rule("^utm_source=", "block"),
    Rule("^print=1|", "block"),
    Rule("^page=*^ref=", "block"),
    Rule("||ads.", "block"),
    Rule("||ads-track.", "block"),
    Rule("||m.*.html|", "block"),
    Rule(".exe|", "block"),
    Rule(".jpg^", "block"),
    Rule(".zip|", "block"),
    Rule("||blog.*^utm_source=", "allow"),
    Rule("/wiki/*^page=*^ref=", "allow"),
    Rule("/docs/*^print=1|", "allow"),
]


def compiled(pattern: str) -> tuple[str, list[str]]:
    """(regular expression, tokens that every match holds whole) of a rule's pattern."""
    body, regex, bounded = pattern, "", False
    if body.startswith("||"):
        body, regex, bounded = body[2:], r"^(?:[^/?#]*\.)?", True
    elif body.startswith("|"):
        body, regex, bounded = body[1:], "^", True
    closed = body.endswith("|")
    pieces = re.split(r"([*^])", body[:-1] if closed else body)
    tokens = set()
    for at, piece in enumerate(pieces):
        if piece == "*":
            regex += r"[\s\S]*"
        elif piece == "^":
            regex += r"(?:[^a-z0-9_.%-]|\z)"
        else:
            regex += "".join(c if c.isalnum() or ord(c) > 127 or c in "/_" else f"\\{c}" for c in piece)
            left = bounded if at == 0 else pieces[at - 1] == "^"
            right = closed if at == len(pieces) - 1 else pieces[at + 1] == "^"
            folded = piece.translate(str.maketrans(UPPER, LOWER))
            tokens |= {m[0] for m in re.finditer(TOKEN, folded) if (m.start() or left) and (m.end() < len(piece) or right)}
    return regex + (r"\z" if closed else ""), sorted(tokens)


def parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, host and all that follows it) of a URL."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.concat(host, F.regexp_extract(rest, r"^[^/?#]*([\s\S]*)", 1))


def tokens_of(target: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(target, UPPER, LOWER), F.lit(TOKEN), F.lit(0)))


def rarest(urls: DataFrame, rules: list[Rule], url: str = "url") -> list[str | None]:
    """For each rule the token that indexes it: of its whole tokens the one in the fewest URLs, then the smallest."""
    own = [compiled(r.pattern)[1] for r in rules]
    every = sorted({t for ts in own for t in ts})
    if not every:
        return [None] * len(rules)
    held = F.array_intersect(tokens_of(parts(F.col(url))[2]), literal(every, "array<string>"))
    counts = dict(urls.select(F.explode(held).alias("token")).groupBy("token").agg(F.count(F.lit(1))).collect())
    return [min(ts, key=lambda t: (counts.get(t, 0), t)) if ts else None for ts in own]


def literal(value, kind: str) -> Column:
    """A nested value as one constant."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def judged(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(key, host, path, rule, pattern, verdict): the text of the host rule or else the pattern that decides, null for none."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; an index holds {MAX_RULES} at most")
    ranked = sorted(rules, key=lambda r: (not r.is_host, -len(r.text), r.verdict != "block", r.text))
    index_tokens = rarest(pages, ranked, url)
    size = 1 << max(1, len(ranked)).bit_length()
    buckets, always = [[] for _ in range(size)], []
    for no, (rule, token) in enumerate(zip(ranked, index_tokens, strict=True)):
        entry = {"no": no, "token": token, "regex": compiled(rule.pattern)[0], "exact": rule.is_host}
        (always if token is None else buckets[zlib.crc32(token.encode()) % size]).append(entry)
    kind = "array<struct<no:int,token:string,regex:string,exact:boolean>>"
    index, loose = literal(buckets, f"array<{kind}>"), literal(always, kind)
    host, path, target = parts(F.col(url))
    src = pages.select(F.col(key).alias("__key"), F.coalesce(host, F.lit("")).alias("__host"), F.coalesce(path, F.lit("")).alias("__path"), F.coalesce(target, F.lit("")).alias("__target"))
    src = src.withColumns({"__lower": F.translate("__target", UPPER, LOWER), "__tokens": tokens_of(F.col("__target"))})
    fetch = lambda t: F.filter(F.get(index, (F.crc32(t) % size).cast("int")), lambda c: c["token"] == t)
    candidates = F.concat(F.flatten(F.transform("__tokens", fetch)), loose)
    fits = lambda c: F.rlike(F.when(c["exact"], F.col("__target")).otherwise(F.col("__lower")), c["regex"])
    best = F.array_min(F.transform(F.filter(candidates, fits), lambda c: c["no"]))
    about = literal([r._asdict() for r in ranked], "array<struct<text:string,verdict:string,is_host:boolean>>")
    src = src.withColumn("__rule", F.get(about, best))
    rule = F.col("__rule")
    return src.select(
        F.col("__key").alias(key),
        F.col("__host").alias("host"),
        F.col("__path").alias("path"),
        F.when(rule["is_host"], rule["text"]).alias("rule"),
        F.when(~rule["is_host"], rule["text"]).alias("pattern"),
        F.coalesce(rule["verdict"], F.lit(default)).alias("verdict"),
    )


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    # two columns, read in place: no need to deal the rows out over the cores with their pages
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), HOSTS + PATTERNS)


def _sql() -> str:
    """Every rule tested on every URL."""
    hosts = sorted(HOSTS, key=lambda r: -len(r.text))
    patterns = sorted(PATTERNS, key=lambda r: (-len(r.text), r.verdict != "block", r.text))
    cut = {r: r.text.index("/") for r in hosts}
    fits = {r: f"(host = '{r.text[: cut[r]]}' or ends_with(host, '.{r.text[: cut[r]]}')) and starts_with(path, '{r.text[cut[r] :]}')" for r in hosts}
    fits |= {r: f"regexp_matches(lower_rest, '{compiled(r.pattern)[0]}')" for r in patterns}
    case = lambda rules, of: "case " + " ".join(f"when {fits[r]} then '{of(r)}'" for r in rules) + " end"
    return f"""
with after as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
cut as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path,
    translate(rest, '{UPPER}', '{LOWER}') as lower_rest
  from after)
select page_id, host, path, rule, case when rule is null then pattern end as pattern, verdict
from (
  select page_id, host, path, {case(hosts, lambda r: r.text)} as rule, {case(patterns, lambda r: r.text)} as pattern,
    coalesce({case(hosts, lambda r: r.verdict)}, {case(patterns, lambda r: r.verdict)}, 'allow') as verdict
  from cut) judged"""


OP12_SQL = _sql()
