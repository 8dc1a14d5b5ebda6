"""Operator 7, personal data: spans of four kinds, and information-theoretic sanitisation of terms that reveal them.

Base spans are the leftmost non-overlapping matches of each kind's pattern that pass its check; a match that fails is dropped
without another try. Starts and ends count code points, ends are exclusive.

The sanitisation treats every value found (an address, a card number, ...) as a protected entity, however few documents
hold it. Over all documents it counts the documents of each term, of each entity, and of both together; a term t discloses
an entity e by the pointwise mutual information log2(P(e|t) * N / n(e)), which reaches e's information log2(N / n(e)) where
the term occurs only with e. P(e|t) is (n(t,e) + 1/2) / (n(t) + 1), the estimate under Jeffreys' prior: a term seen once, with
e, loses 0.42 bits, one seen twice 0.26, one seen ten times 0.07. Terms whose share of e's information is `disclosure` or more
disclose it: at 0.95, a single document is evidence enough among 315 documents and more, two documents among 77 and more. In
documents with e such terms are spans of kind "term", unless a base span holds them, and are removed; base spans are
generalised to their kind.
Terms are runs of letters and digits of any length, in lower case (of all scripts).

The patterns never give back what they have taken and begin a match only where a run of the kind's first signs begins or
where the last match has ended: a later place within a run ends where the run does and fails as the run did. So they find
what the plain patterns find, in time in proportion to the text and without recursion, however long a run is.

Everything runs in DataFrame functions. Offsets come from the lengths of matches and of the text between them, summed up in
logarithmically many passes over the array. Entities are counted by partial sums; those of the same documents have the same
counts with every term and are one group, so a list of addresses that stand nowhere else is a single one. Pairs of a term and
a group are made where the term's count in the documents with base spans, which bounds its full count from below, still lets
it disclose the group.

Nulls count as empty texts; keys may repeat or be null: each row is a document; tables without rows give none; columns
called spans are replaced.
"""

from __future__ import annotations

import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, table, written

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a document must hold for a match of the kind to be possible.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
DISCLOSURE = 0.95
#: Terms that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
#: Code points of the blocks that a text's pieces are cut from.
BLOCK = 4096
SPAN = "array<struct<kind:string,start:long,stop:long,value:string>>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(lengths: Column, join: Callable[[Column, Column], Column] = operator.add) -> Column:
    """Sums of an array up to each element (or what else joins two of them), in log2(size) passes."""
    steps = F.sequence(F.lit(0), F.greatest(F.ceil(F.log2(F.greatest(F.size(lengths), F.lit(1)))).cast("int") - 1, F.lit(0)))
    back = lambda k: F.call_function("shiftleft", F.lit(1), k)
    return F.aggregate(steps, lengths, lambda a, k: F.transform(a, lambda v, i: F.when(i >= back(k), join(v, F.get(a, i - back(k)))).otherwise(v)))


def luhn(digits: Column) -> Column:
    back = F.split(F.reverse(digits), "")
    doubled = F.transform(back, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1)))
    return F.aggregate(doubled, F.lit(0), lambda a, v: a + v) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        # leading zeros aside, at most three digits, then at most 255
        part = lambda x: F.regexp_replace(x, "^0+(?=.)", "")
        return F.forall(F.split(value, r"\."), lambda x: (F.length(part(x)) <= 3) & (F.substring(part(x), 1, 3).cast("int") <= 255))
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(F.lit(False))
    return F.length(digits).between(8, 15)


def kind_spans(text: Column, kind: str) -> Column:
    """Spans of one kind in a text that is not null."""
    p = PATTERNS[kind]
    found = F.regexp_extract_all(text, F.lit(p), F.lit(0))
    none = F.array().cast(SPAN)

    def located(values: Column) -> Column:
        between = F.transform(F.slice(F.split(text, p, -1), F.lit(1), F.size(values)), lambda x: F.length(x).cast("long"))
        own = F.transform(values, lambda x: F.length(x).cast("long"))
        ends = running(F.zip_with(between, own, lambda a, b: a + b))
        spans = F.zip_with(values, ends, lambda v, e: F.struct(F.lit(kind).alias("kind"), (e - F.length(v)).alias("start"), e.alias("stop"), v.alias("value")))
        return F.filter(spans, lambda s: passes(kind, s["value"]))

    # Each step is held once in a lambda's variable, else the optimizer would repeat the search for every use.
    spans = F.flatten(F.transform(F.filter(F.array(found), lambda v: F.size(v) > 0), located))
    hint = HINTS[kind]
    return F.when(F.contains(text, F.lit(hint)), spans).otherwise(none) if hint else spans


def base_spans(text: Column) -> Column:
    """All base spans of a text, by kind and then by place; null: none."""
    t = F.coalesce(text, F.lit(""))
    return F.concat(*(F.coalesce(kind_spans(t, k), F.array().cast(SPAN)) for k in KINDS))


def terms(text: Column) -> Column:
    """Distinct terms of a text."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def discloses(n_both: Column, n_t: Column, n_e: Column, n: int, disclosure: float) -> Column:
    """Whether a term of n_t documents, n_both of them with the entity, has so large a share of the entity's information."""
    info = F.log2(F.lit(float(n)) / n_e)
    return (info > 0) & (F.log2((n_both + 0.5) / (n_t + 1.0)) + info >= disclosure * info)


def grouped(found: DataFrame) -> DataFrame:
    """(row, groups array<(id, n_e)>): groups of entities that occur in the same documents, n_e of them. found: (row, entities array<long>)."""
    pairs = found.select("row", F.explode("entities").alias("entity"))
    place = lambda seed: F.sum(F.xxhash64("row", F.lit(seed)).cast("decimal(38,0)"))
    known = pairs.groupBy("entity").agg(F.count("*").alias("n_e"), place(1).alias("a"), place(2).alias("b")).select("entity", F.struct(F.xxhash64("n_e", "a", "b").alias("id"), "n_e").alias("group"))
    return pairs.distinct().join(written(known, "entities"), "entity").groupBy("row").agg(F.collect_set("group").alias("groups"))


def disclosing(found: DataFrame, docs: DataFrame, text: str, disclosure: float = DISCLOSURE) -> DataFrame:
    """(row, __terms array<long>): hashes of the terms of a text that disclose an entity in it. found: (row, entities array<long>, text) of documents with base spans."""
    n = docs.count()
    each = lambda df, *kept: df.select(*kept, F.explode(terms(F.col(text))).alias("t")).select(*kept, F.xxhash64("t").alias("term"))
    near = written(each(found).groupBy("term").agg(F.count("*").alias("n_p")), "vocabulary")
    possible = lambda g: discloses(F.least(g["n_e"], "n_p"), F.col("n_p"), g["n_e"], n, disclosure)
    pairs = each(found.join(written(grouped(found), "groups"), "row"), "row", "groups").join(small(near, BROADCAST_ROWS), "term")
    pairs = written(pairs.select("row", "term", F.explode(F.filter("groups", possible)).alias("g")).select("row", "term", "g.id", "g.n_e"), "pairs")
    both = written(pairs.groupBy("id", "term").agg(F.first("n_e").alias("n_e"), F.count("*").alias("n_both")), "together")
    # only these terms' documents are counted: filtered before the count while they are few enough to send along, else after it
    wanted = written(both.select("term").distinct(), "terms")
    count = lambda df: df.groupBy("term").agg(F.count("*").alias("n_t"))
    few = wanted.count() <= BROADCAST_ROWS
    counts = count(each(docs).join(F.broadcast(wanted), "term", "left_semi")) if few else count(each(docs)).join(wanted, "term", "left_semi")
    rules = both.join(counts, "term").where(discloses(F.col("n_both"), F.col("n_t"), F.col("n_e"), n, disclosure)).select("id", "term")
    return pairs.join(small(written(rules, "rules"), BROADCAST_ROWS), ["id", "term"]).groupBy("row").agg(F.collect_set("term").alias("__terms"))


def with_spans(docs: DataFrame, text: str = "text", disclosure: float = DISCLOSURE) -> DataFrame:
    """docs with spans: base spans by kind and place, then those of disclosing terms (kind "term") by place."""
    rest = [c for c in docs.columns if c != "spans"]
    value = F.transform(F.col("spans"), lambda s: F.xxhash64(s["kind"], s["value"]))
    # a text and its spans depend on nothing else, so rows of equal texts have the same terms
    row = F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.length(F.coalesce(F.col(text), F.lit(""))))
    # the patterns run once; their spans are read with the texts by all that follows
    src = written(docs.select(*rest, base_spans(F.col(text)).alias("spans")), "marked")
    found = written(src.where(F.size("spans") > 0).select(row.alias("row"), F.array_distinct(value).alias("entities"), F.col(text).alias("text")), "personal")
    # (row, __terms)
    told = written(disclosing(found, docs.select(F.col(text).alias("text")), "text", disclosure), "disclosing")
    if told.isEmpty():
        return src
    mine = src.withColumn("__row", F.when(F.size("spans") > 0, row))
    out = mine.where("__row is null").withColumn("__terms", F.lit(None).cast("array<long>")).unionByName(mine.where("__row is not null").join(told.withColumnRenamed("row", "__row"), "__row", "left").select(*mine.columns, "__terms"))
    extra = F.when(F.size("__terms") > 0, outside(F.col("spans"), term_spans(F.coalesce(F.col(text), F.lit("")), F.col("__terms")))).otherwise(F.array().cast(SPAN))
    return out.select(*rest, F.concat("spans", extra).alias("spans"))


def removed(marked: DataFrame, text: str = "text") -> DataFrame:
    """(kind, documents, spans, characters, share): what the spans of with_spans() take from the texts, by kind.

    share is that of all characters; characters that two kinds hold count for both. Kinds without spans have no row.
    """
    total = marked.agg(F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("total"))
    each = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), (s["stop"] - s["start"]).alias("n")))
    kinds = F.array_distinct(F.transform("spans", lambda s: s["kind"]))
    rows = marked.select(F.explode(kinds).alias("kind"), each.alias("each"))
    own = F.filter("each", lambda s: s["kind"] == F.col("kind"))
    sums = rows.select("kind", F.size(own).alias("spans"), F.aggregate(own, F.lit(0).cast("long"), lambda a, s: a + s["n"]).alias("characters"))
    by_kind = sums.groupBy("kind").agg(F.count(F.lit(1)).alias("documents"), F.sum("spans").alias("spans"), F.sum("characters").alias("characters"))
    return by_kind.withColumn("share", F.try_divide("characters", F.lit(total.first()[0])))


def outside(base: Column, terms_: Column) -> Column:
    """Those term spans, by place, that lie in no base span: none that begins before or with them reaches their end."""
    tagged = lambda spans, n: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("term"), s["stop"].alias("stop"), s["kind"].alias("kind"), s["value"].alias("value")))

    def kept(both: Column) -> Column:
        reach = running(F.transform(both, lambda s: F.when(s["term"] == 0, s["stop"]).otherwise(F.lit(0).cast("long"))), F.greatest)
        span = lambda s: F.struct(*(s[c].alias(c) for c in ("kind", "start", "stop", "value")))
        return bound(reach, lambda r: F.array_compact(F.transform(both, lambda s, i: F.when((s["term"] == 1) & (F.get(r, i) < s["stop"]), span(s)))))

    return bound(F.array_sort(F.concat(tagged(base, 0), tagged(terms_, 1))), kept)


def term_spans(text: Column, chosen: Column) -> Column:
    """Spans of the chosen terms' occurrences."""
    p = r"[\p{L}\p{N}]+"
    words = F.regexp_extract_all(text, F.lit(p), F.lit(0))

    def located(values: Column) -> Column:
        between = F.transform(F.slice(F.split(text, p, -1), F.lit(1), F.size(values)), lambda x: F.length(x).cast("long"))
        ends = running(F.zip_with(between, values, lambda a, v: a + F.length(v)))
        spans = F.zip_with(values, ends, lambda v, e: F.struct(F.lit("term").alias("kind"), (e - F.length(v)).alias("start"), e.alias("stop"), v.alias("value")))
        return F.filter(spans, lambda s: F.array_contains(chosen, F.xxhash64(F.lower(s["value"]))))

    return F.flatten(F.transform(F.filter(F.array(words), lambda v: F.size(v) > 0), located))


def sanitised(docs: DataFrame, text: str = "text", disclosure: float = DISCLOSURE) -> DataFrame:
    """docs with spans, and with the text rewritten: base spans become [KIND], disclosing terms go.

    Of overlapping spans the one that starts first, then the longer, is rewritten, and the later keep nothing of their own.
    """
    marked = with_spans(docs, text, disclosure)
    return marked.withColumn(text, F.when(F.size("spans") > 0, rewritten(F.col(text), F.col("spans"))).otherwise(F.col(text)))


def rewritten(text: Column, spans: Column) -> Column:
    """A text with its spans, one at least, replaced; in time in proportion to text and spans, so pieces are cut from blocks."""
    mark = lambda kind: F.when(kind == "term", "").otherwise(F.concat(F.lit("["), F.upper(kind), F.lit("]")))
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("last"), s["kind"].alias("kind"))))

    def cut(blocks: Column, o: Column, reach: Column) -> Column:
        def piece(a: Column, b: Column) -> Column:
            first, last = F.floor(a / BLOCK).cast("int"), F.floor((b - 1) / BLOCK).cast("int")
            near = F.array_join(F.slice(blocks, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
            return F.when(b > a, F.substr(near, (a - first * BLOCK + 1).cast("int"), (b - a).cast("int"))).otherwise("")

        # a span that begins inside what is already replaced adds nothing; one that reaches further takes the rest along
        at = lambda i: F.when(i > 0, F.get(reach, i - 1)).otherwise(F.lit(0).cast("long"))
        fresh = F.filter(F.transform(o, lambda s, i: F.struct(at(i).alias("at"), s["start"].alias("start"), s["kind"].alias("kind"))), lambda p: p["start"] >= p["at"])
        parts = F.transform(fresh, lambda p: F.concat(piece(p["at"], p["start"]), mark(p["kind"])))
        return F.concat(F.array_join(parts, ""), piece(F.get(reach, F.size(reach) - 1), F.length(text).cast("long")))

    reached = lambda o: running(F.transform(o, lambda s: -s["last"]), F.greatest)
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return bound(blocks, lambda b: bound(order, lambda o: bound(reached(o), lambda r: cut(b, o, r))))


def listed(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:stop, joined by commas, in the order of the array."""
    kept = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else spans
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return marked.select("doc_id", *(count(k) for k in KINDS), F.sha2(listed(F.col("spans"), KINDS), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
