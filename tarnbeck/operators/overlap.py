"""Held-out firewalls, semi-join shares, exact and near-duplicate question joins, disagreements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnbeck.functions.text import NEAR_DUP_BAND, answers_agree, char_ngrams, jaccard, normalise_question, tokens

from .staging import written


def held_out_keys(rows: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """(name, value): distinct keys that are not null or empty."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), c.cast("string").alias("value")) for n, c in keys.items())))
    return rows.select(each.alias("k")).select("k.*").where("value is not null and value <> ''").distinct()


def firewall(rows: DataFrame, held: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """rows with held_out: the first key, in order, by which a row is held out, else null.

    A hash join per key that keeps every row once; key sets are distinct, so none multiplies rows.
    """
    out = rows
    for n, c in keys.items():
        part = held.where(F.col("name") == n).select(F.col("value").alias(f"__v_{n}"), F.lit(True).alias(f"__hit_{n}"))
        out = out.join(part, c.cast("string") == part[f"__v_{n}"], "left")
    first = F.coalesce(*(F.when(F.col(f"__hit_{n}"), F.lit(n)) for n in keys), F.lit(None).cast("string"))
    return out.withColumn("held_out", first).select(*rows.columns, "held_out")


def overlap_share(subject: DataFrame, reference: DataFrame, key: str, label: str) -> DataFrame:
    """One row (label, hits, total, share): subject rows whose key the reference has; null keys hit nothing."""
    known = reference.select(F.col(key)).where(F.col(key).isNotNull()).distinct().withColumn("__hit", F.lit(1))
    return subject.join(known, key, "left").agg(F.count("__hit").alias("hits"), F.count("*").alias("total")).select(F.lit(label).alias("label"), "hits", "total", F.coalesce(F.try_divide("hits", "total"), F.lit(0.0)).alias("share"))


def question_matches(subject: DataFrame, reference: DataFrame) -> DataFrame:
    """(s_id, r_id, same_table): one best match of equal normal form for each subject (id, question, table)."""
    s = subject.select(F.col("id").alias("s_id"), normalise_question(F.col("question")).alias("norm"), F.col("table").alias("s_table")).where("norm <> ''")
    r = reference.select(F.col("id").alias("r_id"), normalise_question(F.col("question")).alias("norm"), F.col("table").alias("r_table"))
    # the best match is a maximum for each (text, table) and for each text, so a text that many rows share makes no pairs
    by_table = r.groupBy("norm", F.col("r_table").alias("s_table")).agg(F.max("r_id").alias("own"))
    by_text = r.groupBy("norm").agg(F.max("r_id").alias("best"))
    return s.join(by_text, "norm").join(by_table, ["norm", "s_table"], "left").select("s_id", F.coalesce("own", "best").alias("r_id"), F.col("own").isNotNull().alias("same_table"))


def token_pairs(subject: DataFrame, reference: DataFrame, t: float) -> DataFrame:
    """(s_id, r_id, jaccard): pairs of (id, question) whose token sets have a similarity of t, over 0, or more.

    Prefix-filtered: of sets with token similarity t, the first n - ceil(t n) + 1 tokens in a common order have one in
    common, so rare tokens alone are joined on, with the size bound in the join. The order is by frequency, tokens that the
    reference lacks first: those join nothing, and a subject with so many of them that they fill its prefix goes at once,
    as does one that is too large or too small for every reference row.
    """
    r = reference.select(F.col("id").alias("r_id"), tokens(F.col("question")).alias("tokens")).withColumn("r_n", F.size("tokens")).where("r_n > 0")
    s = subject.select(F.col("id").alias("s_id"), tokens(F.col("question")).alias("tokens")).withColumn("s_n", F.size("tokens")).where("s_n > 0")
    least, most = r.agg(F.min("r_n"), F.max("r_n")).first()
    if least is None:
        least, most = 1, 0
    s = s.where((F.col("s_n") >= F.lit(t) * least - 1e-9) & (F.col("s_n") * F.lit(t) <= most + 1e-9))
    each = lambda df, *kept: df.select(*kept, F.explode("tokens").alias("token"))
    mine = each(r).groupBy("token").agg(F.count("*").alias("df"))
    freq = each(s).join(mine.select("token"), "token", "left_semi").groupBy("token").agg(F.count("*").alias("more"))
    freq = mine.join(freq, "token", "left").select("token", (F.col("df") + F.coalesce("more", F.lit(0))).alias("df"))

    def prefix(df: DataFrame, p: str) -> DataFrame:
        known = each(df, f"{p}_id", f"{p}_n").join(freq, "token")
        rows = known.groupBy(f"{p}_id", f"{p}_n").agg(F.sort_array(F.collect_set(F.struct("df", "token"))).alias("known"))
        length = F.col(f"{p}_n") - F.ceil(F.lit(t) * F.col(f"{p}_n") - 1e-9) + 1
        left = length - (F.col(f"{p}_n") - F.size("known"))
        return rows.select(f"{p}_id", f"{p}_n", F.explode(F.slice("known", F.lit(1), F.greatest(left, F.lit(0)).cast("int"))["token"]).alias("token"))

    size_ok = F.least("s_n", "r_n") >= F.lit(t) * F.greatest("s_n", "r_n") - 1e-9
    pairs = prefix(s, "s").join(prefix(r, "r"), "token").where(size_ok).select("s_id", "r_id").distinct()
    sets = lambda df, p: df.select(f"{p}_id", F.col("tokens").alias(f"{p}_tokens"))
    close = pairs.join(sets(s, "s"), "s_id").join(sets(r, "r"), "r_id")
    return close.select("s_id", "r_id", jaccard(F.col("s_tokens"), F.col("r_tokens")).alias("jaccard")).where(F.col("jaccard") >= t)


def _with_forms(pairs: DataFrame, subject: DataFrame, reference: DataFrame, exclude_exact: bool) -> DataFrame:
    """pairs with the normal forms of both texts (s_norm, r_norm), made again only for them."""
    norm = lambda df, p: df.select(F.col("id").alias(f"{p}_id"), normalise_question(F.col("question")).alias(f"{p}_norm"))
    both = pairs.join(norm(subject, "s"), "s_id").join(norm(reference, "r"), "r_id")
    return both.where("s_norm <> r_norm") if exclude_exact else both


def _grams() -> Column:
    return jaccard(char_ngrams(F.col("s_norm")), char_ngrams(F.col("r_norm")))


def near_duplicate_pairs(subject: DataFrame, reference: DataFrame, band: tuple[float, float] = NEAR_DUP_BAND[-1], exclude_exact: bool = True) -> DataFrame:
    """(s_id, r_id, jaccard, ngram): pairs of (id, question) with both similarities at or over the band."""
    scored = _with_forms(token_pairs(subject, reference, band[0]), subject, reference, exclude_exact)
    return scored.withColumn("ngram", _grams()).where(F.col("ngram") >= band[1]).select("s_id", "r_id", "jaccard", "ngram")


#: Similarities at which the search for the best pairs widens; the last one leaves out nothing that shares a token.
STEPS = (1.0, 0.9, 0.8, 0.65, 0.5, 0.35, 0.2, 0.1, 1e-9)


def top_pairs(subject: DataFrame, reference: DataFrame, k: int, exclude_exact: bool = True, steps: tuple[float, ...] = STEPS) -> DataFrame:
    """(s_id, r_id, jaccard, ngram): the k best pairs of (id, question) by jaccard, ngram and then the smaller ids.

    The threshold falls until k pairs reach it: those are better than all pairs below it, which are neither joined nor
    scored. The k-th best token similarity then is the threshold for scoring n-grams. Only pairs that share a token count,
    so there may be fewer than k. Ids that repeat make a pair each.
    """
    for t in steps:
        found = written(_with_forms(token_pairs(subject, reference, t), subject, reference, exclude_exact), "pairs")
        if t == steps[-1] or found.count() >= k:
            break
    least = found.orderBy(F.desc("jaccard")).limit(k).agg(F.min("jaccard")).first()[0]
    best = found.where(F.col("jaccard") >= F.lit(least)).withColumn("ngram", _grams()).select("s_id", "r_id", "jaccard", "ngram")
    return best.orderBy(F.desc("jaccard"), F.desc("ngram"), "s_id", "r_id").limit(k)


def sensitivity(pairs: DataFrame, bands: tuple[tuple[float, float], ...] = NEAR_DUP_BAND) -> DataFrame:
    """(jaccard_floor, ngram_floor, pairs) for every band."""
    counts = pairs.agg(*(F.count_if((F.col("jaccard") >= a) & (F.col("ngram") >= b)).alias(f"b{i}") for i, (a, b) in enumerate(bands)))
    rows = F.array(*(F.struct(F.lit(a).alias("jaccard_floor"), F.lit(b).alias("ngram_floor"), F.col(f"b{i}").alias("pairs")) for i, (a, b) in enumerate(bands)))
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def disagreements(subject: DataFrame, reference: DataFrame) -> DataFrame:
    """(norm, s_answer, r_answer, s_id, r_id, s_rows, r_rows): answers that differ under an equal normal form that is not empty.

    One row for every two answers, with the least id and the number of rows that give each, so copies make no pairs.
    """

    def answers(df: DataFrame, p: str) -> DataFrame:
        each = df.select("id", normalise_question(F.col("question")).alias("norm"), F.col("answer").alias(f"{p}_answer")).where("norm <> ''")
        return each.groupBy("norm", f"{p}_answer").agg(F.min("id").alias(f"{p}_id"), F.count("*").alias(f"{p}_rows"))

    both = answers(subject, "s").join(answers(reference, "r"), "norm").where(~answers_agree(F.col("s_answer"), F.col("r_answer")))
    return both.select("norm", "s_answer", "r_answer", "s_id", "r_id", "s_rows", "r_rows")


def distinct_on_shared(subject: DataFrame, reference: DataFrame, key: str, limit: int = 10) -> DataFrame:
    """(key, s_id, r_id): for each shared key the first two rows (id, question) whose texts differ, by ids; at most `limit` keys."""
    s = subject.groupBy(key).agg(F.min_by(F.struct("id", "question"), "id").alias("s"))
    r = reference.join(s, key).where(normalise_question(F.col("question")) != normalise_question(F.col("s.question")))
    return r.groupBy(key).agg(F.min("s.id").alias("s_id"), F.min("id").alias("r_id")).orderBy(key).limit(limit)
