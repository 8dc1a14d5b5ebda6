"""Queries over documents, benchmark, labels, conversations and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnbeck.functions import stats
from tarnbeck.functions import text as T
from tarnbeck.operators import conversations, frames, overlap, pool, ranks, sampling


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


NORM = "trim(regexp_replace(regexp_replace(lower({c}), '[$`\\\\*_>]+', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"
STOP = "[" + ", ".join(f"'{w}'" for w in (*T.STOP_WORDS, "")) + "]"
TOKENS = f"list_sort(list_distinct([w for w in string_split({{n}}, ' ') if NOT list_contains({STOP}, w)]))"
GRAMS = "list_sort(list_distinct([substr(' ' || {n} || ' ', i, 5) for i in range(1, greatest(length({n}) + 2 - 4, 1) + 1)]))"
JACCARD = "coalesce(len(list_intersect({a}, {b})) / nullif(len({a}) + len({b}) - len(list_intersect({a}, {b})), 0), 0)"


def normalised_text(spark, d):
    return read(spark, d, "benchmark").select("item_id", T.normalise_question(F.col("text")).alias("norm"))


def token_sets(spark, d):
    b = read(spark, d, "benchmark")
    return b.select("item_id", F.array_join(T.tokens(F.col("text")), " ").alias("tokens"), F.size(T.char_ngrams(F.col("text"))).cast("long").alias("n_grams"))


def questions(spark, d) -> DataFrame:
    """(id, question, table, answer) from documents: whole texts, source as table, language as answer."""
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("question"), F.col("source").alias("table"), F.col("lang").alias("answer"))


def two_collections(spark, d) -> tuple[DataFrame, DataFrame]:
    """Documents with and without labels."""
    q, known = questions(spark, d), read(spark, d, "labels").select(F.col("doc_id").alias("id")).distinct()
    return q.join(known, "id", "left_semi"), q.join(known, "id", "left_anti")


def exact_dups(spark, d):
    return overlap.question_matches(*two_collections(spark, d))


def _titles(spark, d) -> tuple[DataFrame, DataFrame]:
    items = read(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"))
    # beside the documents, the items without their first word
    edited = items.select((-1 - F.col("id")).alias("id"), F.regexp_replace("question", r"^\S+\s+", "").alias("question"))
    return frames.spread(questions(spark, d).select("id", "question")).unionByName(edited), items


def _near(spark, d) -> DataFrame:
    return overlap.near_duplicate_pairs(*_titles(spark, d), exclude_exact=False)


def near_dups(spark, d):
    out = _near(spark, d)
    return out.withColumns({"jaccard": F.round("jaccard", 6), "ngram": F.round("ngram", 6)})


def near_dups_top(spark, d):
    out = overlap.top_pairs(*_titles(spark, d), 25)
    return out.withColumns({"jaccard": F.round("jaccard", 6), "ngram": F.round("ngram", 6)})


def near_dup_sensitivity(spark, d):
    return overlap.sensitivity(_near(spark, d))


def _keys():
    return {"doc": F.col("doc_id").cast("string"), "text": T.normalise_question(F.col("text"))}


def _held(spark, d) -> DataFrame:
    b = read(spark, d, "benchmark")
    docs = read(spark, d, "documents").where("source = 'src7'").select(T.normalise_question(F.col("text")).alias("value")).where("value <> ''")
    return overlap.held_out_keys(b, {"doc": F.col("item_id").cast("string")}).unionByName(docs.select(F.lit("text").alias("name"), "value").distinct())


def decontaminate_firewall(spark, d):
    marked = overlap.firewall(read(spark, d, "documents"), _held(spark, d), _keys())
    return marked.where("held_out is null").select("doc_id")


def firewall_drop_reasons(spark, d):
    marked = overlap.firewall(read(spark, d, "documents"), _held(spark, d), _keys())
    return marked.groupBy(F.coalesce("held_out", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def disagreements_same_key(spark, d):
    q = questions(spark, d).select("id", "question", F.col("table").alias("answer"))
    return overlap.disagreements(q, q)


def distinct_on_shared_key(spark, d):
    return overlap.distinct_on_shared(*two_collections(spark, d), "table").withColumnRenamed("table", "source")


def exits():
    return [
        ("empty", F.trim(F.coalesce("text", F.lit(""))) == ""),
        ("other language", F.col("lang") != "en"),
        ("too short", F.length("text") < 100),
        ("hot source", F.col("source") == "src0"),
    ]


def pool_funnel_counts(spark, d):
    return pool.exit_counts(pool.funnel(read(spark, d, "documents"), exits(), T.normalise_question(F.col("text")), "doc_id"))


def pool_kept(spark, d):
    return pool.funnel(read(spark, d, "documents"), exits(), T.normalise_question(F.col("text")), "doc_id").where("exit_reason is null").select("doc_id")


def regex_tags(spark, d):
    # patterns without look-around mean the same to all engines on ASCII text
    docs = frames.spread(read(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.regexp_replace("text", r"[^\x20-\x7E]", " ").alias("t"))
    t = F.col("t")
    return docs.select("doc_id", T.op_family(t).alias("family"), F.array_join(T.nondeterminism_reasons(t), ",").alias("nondeterminism"), F.array_join(T.ambiguous_words(t), ",").alias("ambiguity"))


def leak_check(spark, d):
    b = read(spark, d, "benchmark").select("item_id", F.split_part("text", F.lit("."), F.lit(1)).alias("answer"))
    c = read(spark, d, "benchmark").select((F.col("item_id") + 1).alias("item_id"), F.concat_ws(" ", "text", F.lit("and")).alias("prompt"))
    own = read(spark, d, "benchmark").select("item_id", F.col("text").alias("prompt"))
    both = b.join(c.unionByName(own), "item_id")
    hits = T.leaks(F.col("answer"), F.col("prompt"), F.lit("exact_short"))
    return both.groupBy("item_id").agg(F.count_if(F.size(hits) > 0).alias("leaks"))


def scrub_secrets(spark, d):
    c = T.scrub(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.sha2(c, 256).alias("clean"), F.array_join(T.machine_leaks(F.col("text")), ",").alias("found"), F.array_join(T.machine_leaks(c), ",").alias("left"))


def scrub_pages(spark, d):
    p = read(spark, d, "pages")
    return p.select("page_id", F.array_join(T.machine_leaks(F.col("html")), ",").alias("found"), F.size(T.numbers_in(F.col("url"))).cast("long").alias("numbers"))


def wilson_by_criterion(spark, d):
    labels = read(spark, d, "labels")
    each = labels.select(F.explode(F.array(*(F.struct(F.lit(c).alias("criterion"), F.col(c).alias("yes")) for c in ("quality", "toxic")))).alias("r")).select("r.*")
    g = each.groupBy("criterion").agg(F.sum("yes").alias("yes"), F.count("yes").alias("n"))
    w = stats.wilson(F.col("yes"), F.col("n"))
    return g.select("criterion", "yes", "n", F.round(w["low"], 6).alias("low"), F.round(w["high"], 6).alias("high"))


def contingency_paired(spark, d):
    x, y = F.col("quality") == 1, F.col("toxic") == 1
    g = read(spark, d, "labels").agg(F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("first_only"), F.count_if(~x & y).alias("second_only"), F.count_if(~x & ~y).alias("neither"))
    return g.withColumn("p", F.round(stats.sign_test(F.col("first_only"), F.col("second_only")), 6))


def blind_sample(spark, d):
    return sampling.blind_sample(read(spark, d, "documents"), "lang", "doc_id", 10, 17)


def hash_train_val_split(spark, d):
    return sampling.split_by_hash(read(spark, d, "documents"), F.col("doc_id"), 0.05, 0).select("doc_id", "part")


def stable_split(spark, d):
    return sampling.split_stable(read(spark, d, "documents"), F.col("doc_id"), 0.05, 0).groupBy("part").agg(F.count("*").alias("n"))


def trajectory_shape(spark, d):
    return conversations.shape(read(spark, d, "conversations"))


def role_runs(spark, d):
    return conversations.runs(read(spark, d, "conversations")).groupBy("role", "length").agg(F.count("*").alias("n"))


def loop_detection(spark, d):
    m = conversations.messages(read(spark, d, "conversations"))
    roles = F.transform("messages", lambda x: x["role"])
    return m.select("conv_id", F.size("messages").cast("long").alias("turns"), conversations.looped(roles, 2).alias("looped"))


def reason_chain_export(spark, d):
    c, b = read(spark, d, "conversations"), read(spark, d, "benchmark")
    return conversations.export_chain(c, b).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def token_budget_counts(spark, d):
    docs = read(spark, d, "documents").select("source", F.ceil(F.length("text") / 4).alias("tokens"))
    return conversations.token_budget(docs, "source", "tokens", 1000)


def length_quantiles(spark, d):
    docs = read(spark, d, "documents").select("lang", F.length("text").alias("n"))
    return ranks.nearest_ranks(docs, ["lang"], "n", {"p50": 0.5, "p90": 0.9, "p99": 0.99})


def prompt_hashes(spark, d):
    c = read(spark, d, "conversations")
    return c.select("conv_id", "turn", T.sha16(F.col("text")).alias("sha"), T.last_line(F.col("text")).alias("last"), T.slug(F.col("role")).alias("slug"))


def _kappa(spark, d):
    a, b = F.col("quality") == 1, F.col("toxic") == 1
    g = read(spark, d, "labels").where("quality is not null and toxic is not null").agg(F.count("*").alias("n"), F.avg((a == b).cast("double")).alias("agree"), F.avg(a.cast("double")).alias("a"), F.avg(b.cast("double")).alias("b"))
    return g.select("n", F.round("agree", 6).alias("agree"), F.round(stats.kappa(F.col("agree"), F.col("a"), F.col("b")), 6).alias("kappa"))


QUERIES = {f.__name__: f for f in (
    normalised_text, token_sets, exact_dups, near_dups, near_dups_top, near_dup_sensitivity, decontaminate_firewall, firewall_drop_reasons, disagreements_same_key, distinct_on_shared_key,
    pool_funnel_counts, pool_kept, regex_tags, leak_check, scrub_secrets, scrub_pages, wilson_by_criterion, contingency_paired, blind_sample, hash_train_val_split, stable_split,
    trajectory_shape, role_runs, loop_detection, reason_chain_export, token_budget_counts, length_quantiles, prompt_hashes,
)} | {"cohens_kappa": _kappa}

N = NORM.format(c="text")
TITLES = f"""sa AS (SELECT doc_id AS id, {N} AS n FROM documents UNION ALL SELECT -1 - item_id, {NORM.format(c="regexp_replace(text, '^" + chr(92) + "S+" + chr(92) + "s+', '')")} FROM benchmark), ra AS (SELECT item_id AS id, {N} AS n FROM benchmark),
s AS (SELECT id, n, {TOKENS.format(n='n')} AS t FROM sa), r AS (SELECT id, n, {TOKENS.format(n='n')} AS t FROM ra),
sx AS (SELECT id, unnest(t) AS w FROM s), rx AS (SELECT id, unnest(t) AS w FROM r), c AS (SELECT sx.id AS s_id, rx.id AS r_id, count(*) AS k FROM sx JOIN rx USING (w) GROUP BY ALL),
j AS (SELECT s_id, r_id, k / (len(s.t) + len(r.t) - k) AS jaccard, s.n AS sn, r.n AS rn FROM c JOIN s ON s.id = s_id JOIN r ON r.id = r_id),
p AS (SELECT s_id, r_id, jaccard, {GRAMS.format(n='sn')} AS sg, {GRAMS.format(n='rn')} AS rg FROM j WHERE jaccard >= 0.6),
q AS (SELECT s_id, r_id, jaccard, {JACCARD.format(a='sg', b='rg')} AS ngram FROM p)"""
ASCII = "regexp_replace(text, '[^\\x20-\\x7E]', ' ', 'g')"


def _sql(p: str) -> str:
    return p.replace("'", "''")


def _tags(pairs) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(x, '{_sql(p)}') THEN '{n}' END" for n, p in pairs) + ")"


HELD = f"h AS (SELECT 'doc' AS name, CAST(item_id AS VARCHAR) AS v FROM benchmark UNION SELECT 'text', {N} FROM documents WHERE source = 'src7' AND {N} <> ''), f AS (SELECT doc_id, CASE WHEN CAST(doc_id AS VARCHAR) IN (SELECT v FROM h WHERE name = 'doc') THEN 'doc' WHEN {N} IN (SELECT v FROM h WHERE name = 'text') THEN 'text' END AS reason FROM documents)"
FUNNEL = f"""e AS (SELECT doc_id, {N} AS n, CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty' WHEN lang <> 'en' THEN 'other language' WHEN length(text) < 100 THEN 'too short' WHEN source = 'src0' THEN 'hot source' END AS x FROM documents),
m AS (SELECT n, min(doc_id) AS first FROM e WHERE x IS NULL GROUP BY n), k AS (SELECT e.doc_id, CASE WHEN x IS NULL AND doc_id <> first THEN 'duplicate' ELSE x END AS reason FROM e LEFT JOIN m ON e.n = m.n AND x IS NULL)"""
PLAIN = "lower(regexp_replace({c}, '[\\s,_%$]', '', 'g'))"

ORACLE = {
    "normalised_text": f"SELECT item_id, {N} AS norm FROM benchmark",
    "token_sets": f"WITH a AS (SELECT item_id, {N} AS n FROM benchmark) SELECT item_id, array_to_string({TOKENS.format(n='n')}, ' ') AS tokens, len({GRAMS.format(n='n')}) AS n_grams FROM a",
    "exact_dups": f"WITH q AS (SELECT doc_id AS id, {N} AS n, source FROM documents), s AS (SELECT * FROM q WHERE id IN (SELECT doc_id FROM labels) AND n <> ''), r AS (SELECT * FROM q WHERE id NOT IN (SELECT doc_id FROM labels)) SELECT s.id AS s_id, coalesce(max(r.id) FILTER (r.source = s.source), max(r.id)) AS r_id, bool_or(r.source = s.source) AS same_table FROM s JOIN r ON s.n = r.n GROUP BY s.id",
    "near_dups": f"WITH {TITLES} SELECT s_id, r_id, round(jaccard, 6) AS jaccard, round(ngram, 6) AS ngram FROM q WHERE ngram >= 0.4",
    "near_dups_top": f"WITH {TITLES.replace('jaccard >= 0.6', 'sn <> rn')} SELECT s_id, r_id, round(jaccard, 6) AS jaccard, round(ngram, 6) AS ngram FROM q ORDER BY q.jaccard DESC, q.ngram DESC, s_id, r_id LIMIT 25",
    "near_dup_sensitivity": f"WITH {TITLES}, u AS (SELECT * FROM (VALUES (0.9::DOUBLE, 0.8::DOUBLE), (0.8, 0.6), (0.7, 0.5), (0.6, 0.4)) v(jaccard_floor, ngram_floor)) SELECT jaccard_floor, ngram_floor, count(s_id) AS pairs FROM u LEFT JOIN q ON jaccard >= jaccard_floor AND ngram >= ngram_floor GROUP BY ALL",
    "decontaminate_firewall": f"WITH {HELD} SELECT doc_id FROM f WHERE reason IS NULL",
    "firewall_drop_reasons": f"WITH {HELD} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM f GROUP BY 1",
    "disagreements_same_key": f"WITH q AS (SELECT doc_id AS id, {N} AS norm, source AS answer FROM documents), a AS (SELECT norm, answer, min(id) AS id, count(*) AS rows FROM q WHERE norm <> '' GROUP BY ALL) SELECT s.norm, s.answer AS s_answer, r.answer AS r_answer, s.id AS s_id, r.id AS r_id, s.rows AS s_rows, r.rows AS r_rows FROM a s JOIN a r USING (norm) WHERE coalesce(s.answer, '') <> coalesce(r.answer, '')",
    "distinct_on_shared_key": f"WITH q AS (SELECT doc_id AS id, {N} AS n, source FROM documents), s AS (SELECT source, min(id) AS s_id, arg_min(n, id) AS n FROM q WHERE id IN (SELECT doc_id FROM labels) GROUP BY source) SELECT s.source, s_id, min(q.id) AS r_id FROM s JOIN q ON q.source = s.source AND q.id NOT IN (SELECT doc_id FROM labels) AND q.n <> s.n GROUP BY ALL ORDER BY s.source LIMIT 10",
    "pool_funnel_counts": f"WITH {FUNNEL} SELECT coalesce(reason, 'kept') AS exit_reason, count(*) AS n FROM k GROUP BY 1",
    "pool_kept": f"WITH {FUNNEL} SELECT doc_id FROM k WHERE reason IS NULL",
    "regex_tags": f"WITH a AS (SELECT doc_id, {ASCII} AS x FROM documents) SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(x, '{_sql(p)}') THEN '{n}'" for n, p in T.FAMILIES) + f" ELSE 'other' END AS family, {_tags(T.NONDETERMINISM)} AS nondeterminism, {_tags(T.AMBIGUOUS)} AS ambiguity FROM a",
    "leak_check": f"WITH b AS (SELECT item_id, {PLAIN.format(c=chr(39).join(['split_part(text, ', '.', ', 1)']))} AS a FROM benchmark), p AS (SELECT item_id + 1 AS item_id, {PLAIN.format(c=chr(39).join(['text || ', ' and', '']))} AS p FROM benchmark UNION ALL SELECT item_id, {PLAIN.format(c='text')} FROM benchmark) SELECT b.item_id, count(*) FILTER (length(a) >= 4 AND contains(p, a)) AS leaks FROM b JOIN p USING (item_id) GROUP BY b.item_id",
    "wilson_by_criterion": "WITH e AS (SELECT 'quality' AS criterion, quality AS y FROM labels UNION ALL SELECT 'toxic', toxic FROM labels), g AS (SELECT criterion, sum(y)::BIGINT AS yes, count(y) AS n, sum(y) / count(y)::DOUBLE AS p FROM e GROUP BY criterion) SELECT criterion, yes, n, round(greatest(0, ((p + 3.8416 / (2 * n)) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)), 6) AS low, round(least(1, ((p + 3.8416 / (2 * n)) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)), 6) AS high FROM g",
    "cohens_kappa": "WITH g AS (SELECT count(*) AS n, avg((quality = toxic)::INT) AS agree, avg(quality) AS a, avg(toxic) AS b FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL) SELECT n, round(agree, 6) AS agree, round(CASE WHEN a * b + (1 - a) * (1 - b) >= 1 THEN 0 ELSE (agree - (a * b + (1 - a) * (1 - b))) / (1 - (a * b + (1 - a) * (1 - b))) END, 6) AS kappa FROM g",
    "contingency_paired": "WITH g AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS both, count(*) FILTER (quality = 1 AND toxic <> 1) AS first_only, count(*) FILTER (quality <> 1 AND toxic = 1) AS second_only, count(*) FILTER (quality <> 1 AND toxic <> 1) AS neither FROM labels) SELECT *, CASE WHEN first_only + second_only > 0 THEN round(least(1.0, 2 * list_sum([exp(lgamma(first_only + second_only + 1) - lgamma(i + 1) - lgamma(first_only + second_only - i + 1) - (first_only + second_only) * ln(2.0)) for i in range(0, least(first_only, second_only) + 1)])), 6) END AS p FROM g",
    "blind_sample": "WITH r AS (SELECT doc_id, sha256('17:' || lang || ':' || doc_id) AS h, lang FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) AS i FROM r) SELECT doc_id, row_number() OVER (ORDER BY h, doc_id) AS place FROM n WHERE i <= 10",
    "hash_train_val_split": "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('0:' || doc_id), doc_id) AS i, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN i <= round_even(n * 0.05, 0) THEN 'val' ELSE 'train' END AS part FROM r",
    "stable_split": "SELECT CASE WHEN ('0x' || substr(sha256('0:' || doc_id), 1, 8))::BIGINT / 4294967296.0 < 0.05 THEN 'val' ELSE 'train' END AS part, count(*) AS n FROM documents GROUP BY 1",
    "trajectory_shape": "SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'assistant') AS assistant_turns, coalesce(sum(length(text)), 0)::BIGINT AS chars, floor(coalesce(sum(length(text)), 0) / 4)::BIGINT AS est_tokens, coalesce(sum(list_sum([length(x) for x in regexp_extract_all(text, '(?s)```[^\\n]*\\n(.*?)```', 1)])), 0)::BIGINT AS code_chars FROM conversations GROUP BY conv_id",
    "role_runs": "WITH a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS g FROM conversations), r AS (SELECT role, count(*) AS length FROM a GROUP BY conv_id, role, g) SELECT role, length, count(*) AS n FROM r GROUP BY ALL",
    "loop_detection": "WITH m AS (SELECT conv_id, list(role ORDER BY turn) AS r FROM conversations GROUP BY conv_id) SELECT conv_id, len(r) AS turns, len(r) >= 2 AND r[-1] = r[-2] AS looped FROM m",
    "reason_chain_export": f"""WITH h AS (SELECT DISTINCT {N} AS n FROM benchmark), c AS (SELECT conv_id, max(turn) AS last, max(turn) FILTER (role = 'assistant') AS la, arg_max(text, turn) FILTER (role = 'assistant') AS a, bool_or(role = 'user' AND {N} IN (SELECT n FROM h WHERE n <> '')) AS held,
        bool_or(regexp_matches(text, '(?i)/(home|Users)/[^u]') OR contains(text, '/var/tmp/') OR contains(text, '/tmp/smol') OR contains(text, 'kaggle/datasets') OR regexp_matches(text, '{_sql(T.SECRET)}')) AS leak FROM conversations GROUP BY conv_id),
        r AS (SELECT CASE WHEN held THEN 'held out' WHEN la IS NULL THEN 'no assistant turn' WHEN la <> last THEN 'wrong ending' WHEN trim(coalesce(a, '')) = '' THEN 'empty answer' WHEN leak THEN 'machine leak' ELSE 'kept' END AS reason FROM c) SELECT reason, count(*) AS n FROM r GROUP BY reason""",
    "token_budget_counts": "WITH t AS (SELECT source, ceil(length(text) / 4)::BIGINT AS n FROM documents) SELECT source, count(*) AS rows, sum(n)::BIGINT AS raw, sum(least(n, 1000))::BIGINT AS kept, count(*) FILTER (n > 1000) AS over FROM t GROUP BY source",
    "length_quantiles": "WITH s AS (SELECT lang, list(length(text) ORDER BY length(text)) AS v, count(*) AS n FROM documents GROUP BY lang) SELECT lang, " + ", ".join(f"v[1 + CAST(round_even({q} * (n - 1), 0) AS BIGINT)] AS p{int(q * 100)}" for q in (0.5, 0.9, 0.99)) + " FROM s",
    "prompt_hashes": "SELECT conv_id, turn, substr(sha256(text), 1, 16) AS sha, coalesce([trim(x) for x in string_split(text, chr(10)) if trim(x) <> ''][-1], '') AS last, regexp_replace(role, '[^A-Za-z0-9_.-]', '_', 'g') AS slug FROM conversations",
}
