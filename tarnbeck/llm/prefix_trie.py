"""Operator 13, the trie of conversation prefixes.

Turns are sorted by conversation and order into ranges, which may cut a long conversation. Numpy scans over a range give every
turn its depth, the bytes up to it and the polynomial fingerprint of the prefix that ends with it (sums of turn hashes times
powers of an odd base, modulo 2**64); what a range leaves open is handed to those after it, one row a range. Prefixes of equal
depth and fingerprint are candidates for one node. Each group is verified turn by turn: its last turns must all be that of
its representative, and the groups of their parents the same; since that holds at every depth, whole prefixes are equal.
The comparison is the least against the greatest within one aggregate, so a group of any size is reduced where it lies.
Conversations that differ from their representative are split off, from the first turn where they do, until none is left.

The rollup to parents needs no walk through the levels. The smallest member owns a node; from the first node that it owns a
conversation owns all its nodes. So the sums over a subtree are sums over its members of values that each conversation has
once: the bytes that it does not own, and whether it owns a childless end.

Null roles and texts are empty; a null order comes first; turns of equal order are taken by role, then text. Rows with a null
conversation are left out. Rows that repeat are turns each. Without conversations there is no node. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, small, table, written

BASE = 0x9E3779B97F4A7C15
#: Marks of conversations split off that are sent along at most; more go through a shuffle.
BROADCAST_ROWS = 1_000_000
#: Characters of a text that range borders may hold; the order within a range is that of whole texts.
BORDER = 32
#: Bytes of decimal ids in one piece of a node's list of ends.
PIECE_BYTES = 1 << 20
SCANNED = "part int, conv long, depth long, fp long, prev long, n_bytes long, upto long, role string, text string"


def powers(start: int, n: int) -> np.ndarray:
    """BASE to the start, start + 1, ..., modulo 2**64."""
    first = np.uint64(pow(BASE, start, 1 << 64))
    return np.multiply.accumulate(np.r_[first, np.full(max(0, n - 1), BASE, np.uint64)])[:n]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (part, conv, hash, n_bytes, role, text) to SCANNED; depth, fp, prev and upto count from the range's first turn of a conversation."""
    open_conv, at, fp, upto = None, 0, np.uint64(0), 0
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        conv = b.column(1).to_numpy(zero_copy_only=False)
        size = b.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.r_[True, conv[1:] != conv[:-1]]
        starts = np.flatnonzero(first)
        run = np.cumsum(first) - 1
        carried = conv[0] == open_conv
        place = np.arange(n) - starts[run]
        power = powers(0, n)[place]
        if carried:
            power[run == 0] = powers(at, int((run == 0).sum()))
            place[run == 0] += at
        terms = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) * power
        sums, lengths = np.cumsum(terms, dtype=np.uint64), np.cumsum(size)
        fps = sums - (sums[starts] - terms[starts])[run]
        uptos = lengths - (lengths[starts] - size[starts])[run]
        if carried:
            fps[run == 0] += fp
            uptos[run == 0] += upto
        open_conv, at, fp, upto = conv[-1], int(place[-1]) + 1, fps[-1], int(uptos[-1])
        columns = [b.column(0), b.column(1), *map(pa.array, (place + 1, fps.view(np.int64), (fps - terms).view(np.int64), size, uptos)), b.column(4), b.column(5)]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "conv", "depth", "fp", "prev", "n_bytes", "upto", "role", "text"])


def _carries(ends) -> dict[int, tuple[int, int, int, int]]:
    """For each range that goes on with a conversation: (conversation, its turns, fingerprint and bytes before)."""
    out, before = {}, None
    for e in sorted(ends, key=lambda e: e.part):
        depth, fp, upto = e.last.depth, e.last.fp % (1 << 64), e.last.upto
        if before and before[0] == e.first:
            out[e.part] = before
            if e.first == e.last.conv:
                depth, fp, upto = before[1] + depth, (before[2] + pow(BASE, before[1], 1 << 64) * fp) % (1 << 64), before[3] + upto
        before = (e.last.conv, depth, fp, upto)
    return out


def _resumed(carries: dict[int, tuple[int, int, int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, conv = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            depth, fp, prev, upto = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3, 4, 6))
            fp, prev = fp.view(np.uint64), prev.view(np.uint64)
            for p in np.unique(part).tolist():
                if p in carries:
                    c, turns, print_, size = carries[p]
                    on = (part == p) & (conv == c)
                    lift = np.uint64(pow(BASE, turns, 1 << 64))
                    for x in (fp, prev):
                        x[on] = x[on] * lift + np.uint64(print_)
                    depth[on] += turns
                    upto[on] += size
            new = {2: depth, 3: fp.view(np.int64), 4: prev.view(np.int64), 6: upto}
            yield pa.RecordBatch.from_arrays([pa.array(new[i]) if i in new else b.column(i) for i in range(b.num_columns)], names=b.schema.names)

    return run


def scanned(turns: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", bits: int = 64) -> DataFrame:
    """SCANNED of all turns: depth from 1, the fingerprints of the prefix with and without the turn, its bytes and those up to it."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    src = turns.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(order).alias("turn"), empty(role).alias("role"), empty(text).alias("text"))
    within = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    dealt = src.repartitionByRange(*within[:2], F.left("role", F.lit(BORDER)), F.left("text", F.lit(BORDER))).sortWithinPartitions(*within)
    own = F.xxhash64("role", "text") if bits == 64 else F.pmod(F.xxhash64("role", "text"), F.lit(1 << bits))
    dealt = dealt.select(F.spark_partition_id().alias("part"), "conv", own.alias("hash"), F.octet_length("text").cast("long").alias("n_bytes"), "role", "text")
    out = written(dealt.mapInArrow(lean(_scan), SCANNED), "turns")
    last = F.max(F.struct("conv", "depth", "fp", "upto"))
    carries = _carries(out.groupBy("part").agg(F.min("conv").alias("first"), last.alias("last")).collect())  # one row a range
    # written again, as later steps read it several times
    return written(out.mapInArrow(lean(_resumed(carries)), SCANNED), "turns")


KEY = ["depth", "fp", "split"]


def classes(rows: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """(rows with split and prev_split, nodes): equal (depth, fp, split) are equal prefixes, verified turn by turn.

    nodes: (depth, fp, split, n_convs, conv, prev, prev_split): one row for each.
    """
    rows = rows.withColumns({"split": F.lit(0), "prev_split": F.lit(0)})
    for splits in range(1, 1 << 30):
        turn = F.struct("prev", "prev_split", "role", "text")
        groups = written(
            rows.groupBy(*KEY).agg(
                F.count(F.lit(1)).alias("n_convs"),
                F.min("conv").alias("conv"),
                F.min("prev").alias("prev"),
                F.min("prev_split").alias("prev_split"),
                (F.min(turn) == F.max(turn)).alias("alike"),
            ),
            "nodes",
        )
        mixed = groups.where(~F.col("alike")).select(*KEY, F.col("conv").alias("head"))
        if mixed.isEmpty():
            return rows, groups.drop("alike")
        met = rows.join(small(written(mixed, "mixed"), broadcast_rows), KEY)
        heads = met.where("conv = head").select(*KEY, turn.alias("head_turn"))
        odd = met.join(heads, KEY).where(turn != F.col("head_turn")).groupBy("conv").agg(F.min("depth").alias("from_depth"))
        odd = small(written(odd, "odd"), broadcast_rows)
        # a key has one row here; what stands below the first difference is split off with it
        rows = rows.join(odd, "conv", "left").withColumns({
            "split": F.when(F.col("depth") >= F.col("from_depth"), splits).otherwise(F.col("split")),
            "prev_split": F.when(F.col("depth") > F.col("from_depth"), splits).otherwise(F.col("prev_split")),
        }).drop("from_depth")
        rows = written(rows, "turns")
    raise AssertionError("every round splits a group")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, fp, split, conv) to (depth, fp, split, conv, ids): runs of one node as decimal ids joined by commas, conv the first."""
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.column_stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
        conv = b.column(3).to_numpy(zero_copy_only=False)
        most = max(1, PIECE_BYTES // 21)
        cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)])
        cuts = np.concatenate([np.arange(lo, hi, most) for lo, hi in zip(cuts, np.r_[cuts[1:], len(conv)], strict=True)])
        text = [",".join(map(str, conv[lo:hi].tolist())) for lo, hi in zip(cuts, np.r_[cuts[1:], len(conv)], strict=True)]
        cells = [pa.array(keys[cuts, 0]), pa.array(keys[cuts, 1]), pa.array(keys[cuts, 2].astype(np.int32)), pa.array(conv[cuts]), pa.array(text)]
        yield pa.RecordBatch.from_arrays(cells, names=[*KEY, "conv", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by node and conv to (depth, fp, split, ends_sha256); one running hash, whatever the number of pieces."""
    now, running, done = None, None, []

    def flushed():
        cells = [pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.string()))]
        return pa.RecordBatch.from_arrays(cells, names=[*KEY, "ends_sha256"])

    for b in batches:
        for *key, ids in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
            if key != now:
                if now:
                    done.append((*now, running.hexdigest()))
                now, running = key, hashlib.sha256(ids.encode())
            else:
                running.update(b"," + ids.encode())
        yield flushed()
        done = []
    if now:
        done.append((*now, running.hexdigest()))
        yield flushed()


def ends_digests(ends: DataFrame) -> DataFrame:
    """(depth, fp, split, ends_sha256) of (depth, fp, split, conv): ids in ascending order.

    Ranges of sorted ids become pieces of text, so a node that very many conversations end at is read by many tasks; its
    hash, which has to go through the bytes in order, gets pieces only.
    """
    dealt = ends.repartitionByRange(*KEY, "conv").sortWithinPartitions(*KEY, "conv")
    pieces = dealt.mapInArrow(lean(_pieces), "depth long, fp long, split int, conv long, ids string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "conv").mapInArrow(lean(_digests), "depth long, fp long, split int, ends_sha256 string")


def prefix_trie(
    turns: DataFrame,
    convs: DataFrame | None = None,
    conv: str = "conv_id",
    order: str = "turn",
    role: str = "role",
    text: str = "text",
    bits: int = 64,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """One row for each distinct prefix of conversations, the empty one included.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), as the query's contract has
    them, with the smallest member's id for a node and its parent. convs: (conv) of members, for those without a turn.
    bits: of a turn's hash; fewer only make more prefixes collide and be split again.
    """
    rows, nodes = classes(scanned(turns, conv, order, role, text, bits), broadcast_rows)
    spark = turns.sparkSession
    thin = rows.select(*KEY, "conv", "n_bytes", "upto")
    # per conversation: its end, all its bytes, and those before the first node that it owns (all, if it owns none)
    flagged = thin.join(nodes.select(*KEY, F.col("conv").alias("owner")), KEY)
    owned = F.min(F.when(F.col("conv") == F.col("owner"), F.col("upto") - F.col("n_bytes")))
    whole = written(flagged.groupBy("conv").agg(F.max(F.struct(*KEY)).alias("end"), F.max("upto").alias("total"), F.coalesce(owned, F.max("upto")).alias("shared")), "conversations")
    every = whole.select("conv", "end", "shared")
    if convs is not None:
        bare = convs.select(F.col(conv).cast("long").alias("conv")).where("conv is not null").distinct().join(whole.select("conv"), "conv", "left_anti")
        every = every.unionByName(bare.select("conv", F.struct(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("fp"), F.lit(0).alias("split")).alias("end"), F.lit(0).cast("long").alias("shared")))
    every = written(every, "members")
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("prev").alias("fp"), F.col("prev_split").alias("split")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = written(nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    # the owner of a childless node ends there
    leaf = nodes.where("n_children = 0").select("conv", F.lit(1).alias("leaf"))
    values = whole.select("conv", "shared").join(leaf, "conv", "left").withColumn("leaf", F.coalesce("leaf", F.lit(0)))
    not_owned = F.greatest(F.col("shared") - (F.col("upto") - F.col("n_bytes")), F.lit(0))
    sums = thin.join(values, "conv").groupBy(*KEY).agg(F.sum("leaf").alias("n_leaves"), F.sum(not_owned).alias("saved_tokens"))
    tops = written(nodes.join(sums, KEY).select(*KEY, "prev", "prev_split", "conv", "n_convs", "n_children", "n_leaves", "saved_tokens"), "nodes")
    first = tops.where("depth = 1")
    root = every.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.sum("shared").alias("saved_tokens")).where("n_convs > 0")
    under = first.agg(F.count(F.lit(1)).alias("n_children"), F.coalesce(F.sum("n_leaves"), F.lit(0)).alias("leaves")).first()
    nothing = lambda kind: F.lit(None).cast(kind)
    root = root.select(
        *(F.lit(0).cast(kind).alias(c) for c, kind in zip(KEY, ("long", "long", "int"), strict=True)),
        "conv",
        nothing("long").alias("parent_conv_id"),
        "n_convs",
        F.lit(under.n_children).cast("long").alias("n_children"),
        F.lit(max(1, under.leaves)).cast("long").alias("n_leaves"),
        "saved_tokens",
    )
    least = every.agg(F.min("conv")).first()[0]
    above = tops.select((F.col("depth") + 1).alias("depth"), F.col("fp").alias("prev"), F.col("split").alias("prev_split"), F.col("conv").alias("above"))
    deeper = tops.where("depth > 1").join(above, ["depth", "prev", "prev_split"])
    keep = lambda df, parent: df.select(*KEY, "conv", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens")
    out = root.unionByName(keep(first, F.lit(least).cast("long"))).unionByName(keep(deeper, F.col("above")))
    ends = ends_digests(every.select("end.*", "conv"))
    nobody = hashlib.sha256(b"").hexdigest()
    return out.join(ends, KEY, "left").select(
        F.col("conv").alias("conv_id"),
        "depth",
        "parent_conv_id",
        *(F.col(c).cast("long").alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
        F.coalesce("ends_sha256", F.lit(nobody)).alias("ends_sha256"),
    )


#: The query's conversations: the first turns, fewer than so many, come from the conversation whose id is the next lower multiple.
FAMILY, TAKEN = 5, 9


def base_of(conv: Column) -> Column:
    return conv - F.pmod(conv, F.lit(FAMILY))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, turn, role, text), (conv_id)): each conversation with its first turns taken from its family's first one."""
    rows = scanned(turns).select("conv", "depth", "role", "text")
    taken = F.crc32(F.col("conv").cast("string")) % TAKEN
    convs = written(rows.select("conv").distinct(), "conversations")
    own = rows.where((F.col("conv") == base_of(F.col("conv"))) | (F.col("depth") > taken))
    lent = rows.where((F.col("conv") == base_of(F.col("conv"))) & (F.col("depth") < TAKEN)).withColumnRenamed("conv", "base")
    heirs = convs.withColumns({"base": base_of(F.col("conv")), "taken": taken}).where("conv <> base and taken > 0")
    first = heirs.join(lent, "base").where("depth <= taken").select("conv", "depth", "role", "text")
    return own.unionByName(first).toDF("conv_id", "turn", "role", "text"), convs.toDF("conv_id")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuilt(table(spark, sf_dir, "conversations")))


OP13_SQL = """
with recursive ids as (select distinct conv_id as c, cast(conv_id as varchar) as s from conversations where conv_id is not null),
crc as (
  select c, s, 0 as k, cast(4294967295 as bigint) as v from ids
  union all
  select c, s, k + 1, xor(v >> 1, case when v % 2 = 1 then 3988292384 else 0 end)
  from (select c, s, k, case when k % 8 = 0 then xor(v, cast(ascii(substr(s, k // 8 + 1, 1)) as bigint)) else v end as v from crc where k < 8 * length(s)) step),
heads as (select c, c - ((c % 5) + 5) % 5 as base, xor(v, 4294967295) % 9 as h from crc where k = 8 * length(s)),
placed as (
  select conv_id as c, role, text, row_number() over (partition by conv_id order by turn nulls first, role, text) as p
  from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null) whole),
again as (
  select o.c, o.p, o.role, o.text from placed o join heads on heads.c = o.c where o.c = base or o.p > h
  union all
  select heads.c, b.p, b.role, b.text from heads join placed b on b.c = heads.base where heads.c <> heads.base and b.p <= heads.h),
paths as (
  select c, row_number() over (partition by c order by p) as d, octet_length(encode(text)) as n_bytes,
    sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') over (partition by c order by p rows between unbounded preceding and current row)) as path
  from again),
steps as (
  select c, d, n_bytes, path, coalesce(lag(path) over (partition by c order by d), '') as parent from paths
  union all
  select c, 0, 0, '', null from ids),
nodes as (select d, path, min(parent) as parent, min(c) as c, count(*) as n_convs, min(n_bytes) as n_bytes from steps group by d, path),
child as (select d - 1 as d, parent as path, count(*) as n_children from nodes where d > 0 group by d, parent),
counted as (select nodes.*, coalesce(n_children, 0) as n_children from nodes left join child on child.d = nodes.d and child.path = nodes.path),
below as (
  select up.d, up.path, sum(case when n_children = 0 then 1 else 0 end) as n_leaves, sum((n_convs - 1) * counted.n_bytes) as saved
  from counted join steps up on up.c = counted.c and up.d <= counted.d group by up.d, up.path),
lengths as (select c, max(d) as d from steps group by c),
ends as (
  select e.d, s.path, sha256(string_agg(cast(e.c as varchar), ',' order by e.c)) as ends
  from lengths e join steps s on s.c = e.c and s.d = e.d group by e.d, s.path)
select n.c as conv_id, cast(n.d as bigint) as depth, up.c as parent_conv_id, n.n_convs, n.n_children, cast(below.n_leaves as bigint) as n_leaves,
  cast(below.saved as bigint) as saved_tokens, coalesce(ends.ends, sha256('')) as ends_sha256
from counted n join below on below.d = n.d and below.path = n.path
left join nodes up on up.d = n.d - 1 and up.path = n.parent
left join ends on ends.d = n.d and ends.path = n.path"""
