"""Operator 1, document fingerprints by Order MinHash.

The k-mers of a text are its runs of three words, each numbered by how often it has occurred before, so that repeats count.
Every numbered k-mer has one hash, whose first six bits are its bin. Each of the sketch's 64 components has an order of its
own: it goes through the 64 bins in its own sequence, and within a bin by the hash. Each component takes the two k-mers that
are minimal in its order, puts them in the order in which they stand in the text, and hashes the pair to 16 bits. Two
fingerprints' likeness is the share of components that agree: it falls when words change and also when they change places,
so it follows the edit distance rather than the overlap. In a simulation with texts that share four fifths of their k-mers
its standard deviation is 0.06 from 5 to 300 k-mers, as with 64 orders drawn independently.

All of it runs in DataFrame functions. Hashes carry the position in their low 26 bits (beyond 2**26 - 1 words positions count
from the beginning again, and two k-mers so far apart may change places); equal
k-mers are numbered after a sort, by counting runs in logarithmically many passes; the beginnings of the bins are sorted in
among the hashes, and so found without a search. A document's neighbour in key order is found by ranges, without one task
seeing all keys, and brings only the text that is asked for.

A text of fewer words than three is one k-mer; a null text is empty; a text without words has the empty fingerprint, whose
likeness is 1 to itself and 0 to others. Keys may repeat (then ordered by a hash of the text) or be null (first); rows that
repeat key and text each get their row, and stand as one in the order. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

SLOTS, WORDS, FEW = 64, 3, 4
PLACE = (1 << 26) - 1
_STEP = (1 << 64) // SLOTS


def bound(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def numbered(sorted_: Column) -> Column:
    """How many equal k-mers stand before each, in an array sorted by k-mer and place."""
    kmer = lambda x: F.shiftright(x, 26)
    flags = F.transform(sorted_, lambda x, i: F.when((i > 0) & (kmer(x) == kmer(F.get(sorted_, F.greatest(i - 1, F.lit(0))))), F.lit(1)).otherwise(F.lit(0)))
    power = lambda k: F.call_function("shiftleft", F.lit(1), k)

    def counted(f: Column) -> Column:
        repeats = F.aggregate(f, F.lit(0), lambda a, x: a + x)
        steps = F.sequence(F.lit(0), F.ceil(F.log2(repeats + 1.0)).cast("int"))
        doubled = F.aggregate(steps, f, lambda c, k: F.transform(c, lambda v, i: F.when(v == power(k), v + F.when(i >= power(k), F.get(c, i - power(k))).otherwise(F.lit(0))).otherwise(v)))
        return F.when(repeats == 0, f).otherwise(doubled)

    return bound(flags, counted)


def fingerprint(text: Column) -> Column:
    """256 hexadecimal digits, four for each component; empty without words."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    starts = F.array(*(F.lit(-(1 << 63) + j * _STEP) for j in range(SLOTS)))
    place = lambda x: x.bitwiseAND(F.lit(PLACE))
    bare = lambda x: x.bitwiseAND(F.lit(~PLACE))

    def kmers(h: Column) -> Column:
        made = F.transform(h, lambda x, i: bare(F.xxhash64(x, *(F.get(h, i + j) for j in range(1, WORDS)))).bitwiseOR((i % PLACE + 1).cast("long")))
        return F.sort_array(F.slice(made, F.lit(1), F.greatest(F.size(h) - (WORDS - 1), F.lit(1))))

    def hashed(s: Column) -> Column:
        return bound(numbered(s), lambda n: F.transform(s, lambda x, i: bare(F.xxhash64(F.shiftright(x, 26), F.get(n, i))).bitwiseOR(place(x))))

    def components(t: Column) -> Column:
        real = F.filter(t, lambda x: place(x) != 0)
        at = F.filter(F.transform(t, lambda x, i: F.when(place(x) == 0, i)), lambda i: i.isNotNull())

        def slots(r: Column) -> Column:
            # i - j hashes stand before bin j
            return bound(F.concat(F.transform(at, lambda i, j: i - j), F.array(F.size(r))), lambda begins: joined(r, begins))

        def joined(r: Column, begins: Column) -> Column:
            def pair(bins: Column) -> Column:
                first = F.get(begins, F.get(bins, F.lit(0)))
                alone = F.get(begins, F.get(bins, F.lit(0)) + 1) - first == 1
                two = bound(F.when(alone, F.coalesce(F.get(begins, F.get(bins, F.lit(1))), first)).otherwise(first + 1), lambda k: F.array(F.get(r, first), F.get(r, k)))
                return bound(two, text_order)

            def text_order(two: Column) -> Column:
                a, b = F.get(two, F.lit(0)), F.get(two, F.lit(1))
                swap = place(a) > place(b)
                hashed = F.xxhash64(bare(F.when(swap, b).otherwise(a)), bare(F.when(swap, a).otherwise(b)))
                return F.lpad(F.lower(F.hex(hashed.bitwiseAND(F.lit(0xFFFF)))), 4, "0")

            def slot(j: Column) -> Column:
                step = (j * 37 + 11) % 32 * 2 + 1
                held = lambda n: F.filter(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: (k * step % SLOTS).bitwiseXOR(j)), lambda b: F.get(begins, b + 1) > F.get(begins, b))
                # the first few bins of the sequence mostly hold two hashes, else all bins are looked at
                return bound(held(FEW), lambda few: F.when(F.size(few) > 1, pair(few)).otherwise(bound(held(SLOTS), pair)))

            return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), slot), "")

        return bound(real, slots)

    def made(w: Column) -> Column:
        hashes = F.transform(w, lambda x: F.xxhash64(x))
        sorted_ = bound(hashes, kmers)
        return F.when(F.size(w) == 0, F.lit("")).otherwise(bound(F.sort_array(F.concat(bound(sorted_, hashed), starts)), components))

    return bound(words, made)


def likeness(a: Column, b: Column) -> Column:
    """Share of components that agree, 0 to 1."""
    same = F.aggregate(F.sequence(F.lit(0), F.lit(SLOTS - 1)), F.lit(0), lambda n, i: n + (F.substr(a, i * 4 + 1, F.lit(4)) == F.substr(b, i * 4 + 1, F.lit(4))).cast("int"))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(same / SLOTS)


KEY = ("known", "id", "version")


def followers(keys: DataFrame) -> DataFrame:
    """KEY of distinct keys (KEY, n_chars), with prev_* of each: the key before it in order, round the end."""
    ranked = keys.repartitionByRange(*KEY).sortWithinPartitions(*KEY).select(*KEY, "n_chars", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"))
    ranked = written(ranked, "ranked")
    mine = F.struct(*KEY, "n_chars")
    before = ranked.select((F.col("place") + 1).alias("place"), mine.alias("prev"))
    # the first of each part follows the last of the part before; there are as many rows as parts
    last = ranked.groupBy("part").agg(F.max_by(mine, "place").alias("last"), F.min("place").alias("place"))
    ends = last.select("place", F.coalesce(F.lag("last").over(Window.orderBy("part")), F.last("last").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("end"))
    joined = ranked.join(before, "place", "left").join(ends, "place", "left").select(*KEY, F.coalesce("end", "prev").alias("p"))
    return joined.select(*KEY, *(F.col(f"p.{c}").alias(f"prev_{c}") for c in (*KEY, "n_chars")))


def with_neighbour(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, known, text, fingerprint, given, next_fingerprint): given is the first fourth of this text's length of the next one.

    known is 0 for a null key, whose id is then 0. The texts go through one exchange by key, which both joins use; only the
    given part and the fingerprint travel on to the neighbour.
    """
    src = docs.select(F.col(key).isNotNull().cast("int").alias("known"), F.coalesce(F.col(key), F.lit(0)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("version", F.xxhash64("text"))
    keys = src.select(*KEY, F.length("text").alias("n_chars")).dropDuplicates([*KEY])
    order = written(followers(keys), "order")
    full = src.withColumn("fingerprint", fingerprint(F.col("text")))
    given = (
        full.join(order, [*KEY])
        .select(*(F.col(f"prev_{c}").alias(c) for c in KEY), F.expr("substring(text, 1, int(floor(prev_n_chars / 4)))").alias("given"), F.col("fingerprint").alias("next_fingerprint"))
        .dropDuplicates([*KEY])
    )
    return full.join(given, [*KEY]).select("id", "known", "text", "fingerprint", "given", "next_fingerprint")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    both = with_neighbour(table(spark, sf_dir, "documents")).withColumn("edited", F.concat(F.expr("substring(text, 1, length(text) - int(floor(length(text) / 4)))"), "given"))
    both = both.select(F.when(F.col("known") == 1, F.col("id")).alias("id"), n.cast("long").alias("n_chars"), "fingerprint", "next_fingerprint", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("edited")).alias("edited_fingerprint"))
    return both.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
