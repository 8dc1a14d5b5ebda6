"""Operator 2, n-gram Jaccard join by parity sketches.

A document's set holds the distinct hashes of its five-word shingles. Two sets of sizes a <= b with Jaccard similarity of
0.75 or more differ in at most (a + b) / 7 elements, and b <= 4 a / 3. So documents are laid in size bands, and each pair of
neighbouring bands has a bound d on the elements in which a linked pair differs. A set's sketch is cut into p blocks; every
element is XOR-hashed into one block, so the number of blocks that differ is a lower bound of the symmetric difference, and
of linked sketches at most d blocks differ. Blocks are put in an order that depends on their content alone; then the first
d + 1 filled blocks of linked sketches have one in common (pigeonhole), and those are the join keys. Sets that fill no more
than d blocks give all they fill and meet each other under one key of the band. No link is lost by this.

The order puts blocks of frequent shingles last, frequent ones being those that come up again within batches of documents:
this steers work only, results are the same with any choice. Keys travel as binary rows, one for each batch and bucket.

Pairs that meet are verified twice: by the parity bits of a wide sketch (lower bound), then by the sets themselves. Groups of
up to SMALL sets that share a key are verified pair by pair; larger ones against a few centres first, and then, as bit
matrices, the pairs that are still unconnected. So a group of thousands of copies writes pairs in proportion to its size.

Equal sets are one node. Nulls and texts without words are linked with nothing and are their own component; rows that repeat
a key each give a row; a null key gives way to any other as a component's name; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, lean, mix, shingle_sets, slices, small, table, trim, written

WORDS, SHARE = 5, 75
#: Members up to which all pairs of a group are written down, and members of one chunk of a larger group.
SMALL, CHUNK = 16, 512
#: Orders that pick a group's centre, and members, and bytes of sets, that meet as one block.
CENTRES, BLOCK, BLOCK_BYTES = 8, 1024, 8 << 20
#: Documents for each salt of a frequent key.
SALT_DOCS = 1_000_000
#: Shingles in a batch that is searched for repeated ones, and the repeats from which a shingle is frequent.
BATCH_SHINGLES, FREQUENT = 6_000_000, 3
#: Counts at which the second and third class of frequent shingles begin.
COUNTS = (16, 256)
#: Frequent shingles that are sent along at most; beyond it, the least frequent are left out.
MAX_FREQUENT = 2_000_000
KEYS_A_BUCKET = 2_000_000
BROADCAST_ROWS = 500_000
_C = np.uint64(0x2545F4914F6CDD1D)


@lru_cache
def bands(limit: int = 1 << 40) -> np.ndarray:
    """First size of each band."""
    out = [1]
    while out[-1] < limit:
        out.append(max(out[-1] + 1, 4 * (out[-1] - 1) // 3 + 1))
    return np.array(out, np.int64)


@lru_cache(4096)
def plan(level: int) -> tuple[int, int]:
    """(d, p) of the pairs whose smaller set is in band `level`."""
    lo, hi = int(bands()[level]), int(bands()[level + 1]) - 1
    d = (hi + 4 * hi // 3) // 7
    for p in range(d + 1, 8 * lo + 2, max(1, d // 50)):
        x = lo / p
        filled, sigma = p * (1 - math.exp(-x)), math.sqrt(max(0.0, p * (math.exp(-x) - (1 + x) * math.exp(-2 * x))))
        if filled - 4 * sigma >= d + 1:
            return d, p
    return d, 8 * lo + 1


def set_id(s: np.ndarray, seed: int) -> tuple[int, int]:
    """Two independent hashes of a set."""
    with np.errstate(over="ignore"):
        a = mix(s ^ np.uint64(seed * 2 + 1)).sum() + np.uint64(len(s))
        b = (s * _C).sum()
    return int(mix(np.array([a])).view(np.int64)[0]), int(np.array([b], np.uint64).view(np.int64)[0])


def block_keys(s: np.ndarray, level: int, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The join keys of a set among the pairs of a level."""
    d, p = plan(level)
    with np.errstate(over="ignore"):
        h = mix(s * _C + np.uint64(level))
        block = (h % np.uint64(p)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        block = block[order]
        first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        value = np.bitwise_xor.reduceat(mix(h[order] + _C), first)
        kind = np.minimum.reduceat(classes(s[order], frequent), first)
        keys = mix(value ^ mix(block[first].astype(np.uint64) * _C + np.uint64(level)))
        # the first two bits are the class of the block's rarest element, so the order is a property of the key
        keys = (keys >> np.uint64(2)) | (kind << np.uint64(62))
        if len(keys) <= d:
            return np.r_[keys, mix(np.array([level], np.uint64) * _C)]
        return np.partition(keys, d)[: d + 1]


def classes(s: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """0 for elements that are not frequent, else 1 to 3 by how often they came up."""
    known, n = frequent
    if not len(known):
        return np.zeros(len(s), np.uint64)
    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
    return np.where(known[at] == s, n[at], 0).astype(np.uint64)


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that come up again within batches of BATCH_SHINGLES, over all documents, and their classes; equal sets of a batch count once."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(sets: list[np.ndarray]) -> pa.RecordBatch:
            u, c = np.unique(np.concatenate(sets), return_counts=True)
            u, c = u[c > 1], c[c > 1]
            part = (mix(u) % np.uint64(64)).astype(np.int64)
            out = [(k, u[part == k].tobytes(), c[part == k].astype("<u4").tobytes()) for k in range(64)]
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.binary())], names=["part", "s", "c"])

        sets, held, seen = [], 0, set()
        for b in slices(batches, 0, 1000):
            for s in shingle_sets(b.column(0), WORDS):
                if len(s) and (i := set_id(s, 0)) not in seen:
                    seen.add(i)
                    sets.append(s)
                    held += len(s)
            if held >= BATCH_SHINGLES:
                yield packed(sets)
                sets, held, seen = [], 0, set()
        if sets:
            yield packed(sets)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, c = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for b in batches:
            s += [np.frombuffer(x, np.uint64) for x in b.column(1).to_pylist()]
            c += [np.frombuffer(x, "<u4").astype(np.int64) for x in b.column(2).to_pylist()]
        u, inv = np.unique(np.concatenate(s), return_inverse=True)
        n = np.bincount(inv, weights=np.concatenate(c), minlength=len(u)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(u[n >= FREQUENT].view(np.int64)), pa.array(n[n >= FREQUENT])], names=["s", "n"])

    found = written(docs.select("text").mapInArrow(lean(spread), "part int, s binary, c binary").repartition(64, "part").mapInArrow(lean(total), "s long, n long"), "frequent")
    least, held = FREQUENT, 0
    for n, rows in sorted(found.groupBy(F.least("n", F.lit(1000)).alias("n")).count().collect(), reverse=True):
        held += rows
        if held > MAX_FREQUENT:
            least = n + 1
            break
    kept = found.where(F.col("n") >= least).toArrow()
    known, n = kept.column(0).to_numpy().view(np.uint64), kept.column(1).to_numpy()
    order = np.argsort(known)
    return known[order], (1 + np.searchsorted(COUNTS, n[order], side="right")).astype(np.uint8)


def shingle_table(docs: DataFrame, seed: int) -> DataFrame:
    """(doc_id, version, n_shingles, node, check) of each document; version is a hash of its text, node is null where the set is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, 1000):
            n, ids, checks = [], [], []
            for s in shingle_sets(b.column(1), WORDS):
                i, c = set_id(s, seed) if len(s) else (None, None)
                n.append(len(s)), ids.append(i), checks.append(c)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(x, pa.int64()) for x in (n, ids, checks))], names=["doc_id", "version", "n_shingles", "node", "check"])

    version = F.xxhash64(F.coalesce("text", F.lit(""))).alias("version")
    return docs.select("doc_id", "text", version).mapInArrow(lean(run), "doc_id long, version long, n_shingles long, node long, check long")


def meetings(docs: DataFrame, seed: int, frequent: tuple[np.ndarray, np.ndarray], buckets: int, salts: int = 1) -> DataFrame:
    """(a, b, gid, members): pairs that share a key, and larger groups in chunks of members with a null a.

    Keys of frequent blocks are dealt out over `salts` buckets each; such keys always come as chunks.
    """
    sent = docs.sparkSession.sparkContext.broadcast(frequent)
    first = bands()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value

        def packed(nodes: list[int], counts: list[int], keys: list[np.ndarray]) -> pa.RecordBatch:
            k = np.concatenate(keys)
            own = np.repeat(np.arange(len(nodes)), counts)
            salt = np.where(k >> np.uint64(62), own % salts, 0).astype(np.uint64)
            bucket = ((k + salt * np.uint64(7919)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            k, own, nodes = k[order], own[order], np.array(nodes, np.int64)
            rows = []
            for i in range(buckets):
                a, b = cuts[i], cuts[i + 1]
                if a < b:
                    mine, n = np.unique(own[a:b], return_counts=True)
                    # 48 bits tell keys of a bucket apart well enough: verification sees to the rest
                    rows.append((i, nodes[mine].tobytes(), n.astype("<u4").tobytes(), np.ascontiguousarray(k[a:b]).view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[j] for r in rows], pa.binary()) for j in (1, 2, 3))], names=["bucket", "nodes", "counts", "keys"])

        nodes, counts, keys, held, seen = [], [], [], 0, set()
        for b in slices(batches, 0, 1000):
            for s in shingle_sets(b.column(0), WORDS):
                if not len(s):
                    continue
                i = set_id(s, seed)[0]
                if i in seen:
                    continue
                seen.add(i)
                band = int(np.searchsorted(first, len(s), side="right")) - 1
                k = block_keys(s, band, known)
                if band:
                    k = np.r_[k, block_keys(s, band - 1, known)]
                nodes.append(i), counts.append(len(k)), keys.append(k)
                held += len(k)
                if held >= 1_000_000:
                    yield packed(nodes, counts, keys)
                    nodes, counts, keys, held, seen = [], [], [], 0, set()
        if nodes:
            yield packed(nodes, counts, keys)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list[tuple[bytes, bytes, bytes]]] = {}
        for b in batches:
            for i, *x in zip(*(b.column(j).to_pylist() for j in range(4)), strict=True):
                got.setdefault(i, []).append(tuple(x))
        for x in got.values():
            node = np.concatenate([np.repeat(np.frombuffer(n, "<i8"), np.frombuffer(c, "<u4")) for n, c, _ in x])
            raw = np.frombuffer(b"".join(k for _, _, k in x), np.uint8).reshape(-1, 6)
            key = np.zeros((len(raw), 8), np.uint8)
            key[:, 2:] = raw
            key = key.view("<u8")[:, 0]
            order = np.lexsort((node, key))
            key, node = key[order], node[order]
            new = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
            key, node = key[new], node[new]
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[start, len(key)])
            pairs: list[np.ndarray] = []
            split = (key[start] >> np.uint64(62)).astype(bool) & (salts > 1)
            for g in range(2, SMALL + 1):
                at = start[(size == g) & ~split]
                if len(at):
                    m = np.unique(node[at[:, None] + np.arange(g)], axis=0)
                    i, j = np.triu_indices(g, 1)
                    pairs.append(np.stack([m[:, i].ravel(), m[:, j].ravel()], 1))
            if pairs:
                p = np.unique(np.concatenate(pairs), axis=0)
                for lo in range(0, len(p), 50_000):
                    q = p[lo : lo + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(q[:, 0]), pa.array(q[:, 1]), pa.nulls(len(q), pa.int64()), pa.nulls(len(q), pa.list_(pa.int64()))], names=["a", "b", "gid", "members"])
            done = set()
            for g in np.flatnonzero((size > SMALL) | split):
                m = node[start[g] : start[g] + size[g]]
                if split[g]:
                    gid = int(key[start[g]].view(np.int64))
                else:
                    gid = set_id(m.view(np.uint64), 1)[0]
                    if gid in done:
                        continue
                    done.add(gid)
                chunks = [m[lo : lo + CHUNK].tolist() for lo in range(0, len(m), CHUNK)]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(chunks), pa.int64()), pa.nulls(len(chunks), pa.int64()), pa.array([gid] * len(chunks)), pa.array(chunks, pa.list_(pa.int64()))], names=["a", "b", "gid", "members"])

    return docs.select("text").mapInArrow(lean(spread), "bucket int, nodes binary, counts binary, keys binary").repartition(buckets, "bucket").mapInArrow(lean(meet), "a long, b long, gid long, members array<long>")


def sketch(s: np.ndarray) -> np.ndarray:
    """Parity of the elements that fall on each bit; a power of two of bits, eight for each element at least."""
    bits = 1 << max(8, int(8 * len(s) - 1).bit_length())
    with np.errstate(over="ignore"):
        at = (mix(s * _C + np.uint64(3)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little")


def may_link(a: np.ndarray, b: np.ndarray, n: int, m: int) -> bool:
    """Whether the bits that differ, a lower bound of the difference, allow a link of sets of n and m elements."""
    if 100 * min(n, m) < SHARE * max(n, m):
        return False
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum()) * (100 + SHARE) <= (100 - SHARE) * (n + m)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= SHARE * (len(a) + len(b) - common)


def sets_of(docs: DataFrame, wanted: DataFrame, seed: int) -> DataFrame:
    """(node, n, sketch, elements) of wanted (node, nul, id, version), made from the documents again; nul: the key is null, and id 0."""
    asked = small(written(wanted.select("nul", "id", "version", F.col("node").alias("asked")), "asked"), BROADCAST_ROWS)
    keyed = docs.select(F.col("doc_id").isNull().alias("nul"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("version"), "text")
    src = keyed.join(asked, ["nul", "id", "version"]).select("asked", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, 500):
            rows = [(i, len(s), sketch(s).tobytes(), s.tobytes()) for i, s in zip(b.column(0).to_pylist(), shingle_sets(b.column(1), WORDS), strict=True) if len(s) and set_id(s, seed)[0] == i]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["node", "n", "sketch", "elements"])

    return written(src.mapInArrow(lean(run), "node long, n long, sketch binary, elements binary"), "sets")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked."""

    def kept(src: DataFrame, column: str, test) -> DataFrame:
        at = sets.select("node", "n", column)
        both = src.join(at.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col(column).alias("x_a")), "a").join(at.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col(column).alias("x_b")), "b")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for lo in range(0, whole.num_rows, 500):
                    b = whole.slice(lo, 500)
                    ok = [test(x, y, n, m) for x, y, n, m in zip(*(b.column(c).to_pylist() for c in ("x_a", "x_b", "n_a", "n_b")), strict=True)]
                    yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

        return written(both.mapInArrow(lean(run), "a long, b long"), "verified")

    near = kept(pairs, "sketch", lambda x, y, n, m: may_link(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8), n, m))
    return kept(near, "elements", lambda x, y, n, m: linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)))


def across(groups: DataFrame, named: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links within a group (head, node) between members of different components, enough to connect what is linked.

    A group's members are dealt into blocks, and every two blocks meet in one task: memory is bounded by a block, and pairs
    are tested as bit matrices of sketches. A task writes the members that have an allowed pair, not the pairs. Those meet
    again with their sets, by pair of blocks; pairs not yet connected are verified, and the links that connect are written.
    So rows grow with members times blocks, whatever share of a family falls just short of the threshold.
    """
    each = groups.join(named, "node", "left").select("head", "node", F.coalesce("component", "node").alias("component"))
    sized = each.join(sets.select("node", "n"), "node").groupBy("head")
    size = sized.agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m"), (F.sum("n") * 8).alias("bytes")).where("lo <> hi")
    size = size.select("head", F.ceil(F.greatest(F.col("m") / BLOCK, F.col("bytes") / BLOCK_BYTES)).alias("blocks"))
    # a table of its own: a head's members can then be split
    rest = each.join(small(written(size, "group-sizes"), BROADCAST_ROWS), "head").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    rest = rest.join(sets.select("node", "n", "sketch"), "node")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    met = rest.select("head", "node", "component", "n", "sketch", "block", other).withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")})

    def allowed(table: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
        """For each row those after it that its sketch allows, of the other block and in another component."""
        comp, n, block = (table.column(c).to_numpy() for c in ("component", "n", "block"))
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        raw = table.column("sketch").to_pylist()
        width = min(map(len, raw))
        bits = np.zeros((len(raw), width), np.uint8)
        for i, r in enumerate(raw):
            v = np.frombuffer(r, np.uint8)
            while len(v) > width:
                v = v[: len(v) // 2] ^ v[len(v) // 2 :]
            bits[i] = v
        bits = bits.view(np.uint64)
        left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
        for i in left:
            j = right[right > i] if x == y else right
            j = j[(comp[j] != comp[i]) & (100 * np.minimum(n[j], n[i]) >= SHARE * np.maximum(n[j], n[i]))]
            if len(j):
                differ = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64)
                j = j[differ * (100 + SHARE) <= (100 - SHARE) * (n[j] + n[i])]
                if len(j):
                    yield i, j

    def near(table: pa.Table) -> pa.Table:
        hit = np.zeros(table.num_rows, bool)
        for i, j in allowed(table):
            hit[i] = hit[j] = True
        trim()  # a worker takes one group after the other and lives on
        return table.select(["head", "x", "y", "node", "component", "block"]).filter(pa.array(hit))

    def connecting(table: pa.Table) -> pa.Table:
        node, held = table.column("node").to_numpy(), table.column("elements").combine_chunks()
        root = {c: c for c in table.column("component").to_pylist()}
        comp = table.column("component").to_pylist()

        def top(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        elements = lambda i: np.frombuffer(held[int(i)].as_buffer(), np.uint64)
        out = []
        for i, js in allowed(table):
            for j in js.tolist():
                if top(comp[i]) != top(comp[j]) and linked(elements(i), elements(j)):
                    root[top(comp[j])] = top(comp[i])
                    out.append((min(node[i], node[j]), max(node[i], node[j])))
        trim()
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    close = met.groupBy("head", "x", "y").applyInArrow(near, "head long, x long, y long, node long, component long, block long")
    close = written(close, "close-members")
    again = close.join(sets.select("node", "n", "sketch", "elements"), "node")
    return again.groupBy("head", "x", "y").applyInArrow(connecting, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, version, n_shingles, component_id) of every row of docs (doc_id long, text); version is a hash of the text."""
    docs = docs.select("doc_id", "text")
    for seed in range(4):
        sizes = written(shingle_table(docs, seed), "shingles")
        if sizes.where("node is not null").groupBy("node").agg(F.min("check").alias("c"), F.max("check").alias("d"), F.min("n_shingles").alias("m"), F.max("n_shingles").alias("n")).where("c <> d or m <> n").isEmpty():
            break
    else:
        raise RuntimeError("hashes of different sets agree under four seeds")
    n_docs, n_keys = sizes.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    buckets = max(64, min(1 << 20, n_keys // KEYS_A_BUCKET))
    met = written(meetings(docs, seed, frequent_shingles(docs), buckets, -(-max(1, n_docs) // SALT_DOCS)), "met")
    pairs = written(met.where("a is not null").select("a", "b").distinct(), "pairs")
    chunks = written(met.where("a is null").groupBy("gid", "members").agg(F.lit(1)).select("gid", F.xxhash64("members").alias("chunk"), "members"), "chunks")
    # each group is tied to a member that a hash picks, one of CENTRES orders for each group, so a family gets several centres
    salt = F.pmod("gid", F.lit(CENTRES))
    pick = F.array_min(F.transform("members", lambda v: F.struct(F.xxhash64(salt, v).alias("h"), v.alias("v"))))
    heads = chunks.groupBy("gid").agg(F.min(pick)["v"].alias("a"), F.min(F.array_min("members")).alias("head"))
    members = chunks.join(heads, "gid").select("head", "a", F.explode("members").alias("b"))
    groups = written(members.select("head", F.col("b").alias("node")).distinct(), "groups-by-head")
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").unionByName(members.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b")).distinct()
    first = written(first, "first")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(chunks.select(F.explode("members").alias("node"))).distinct()
    reps = sizes.where("node is not null").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nul"), F.coalesce("doc_id", F.lit(0)).alias("id"), "version")).alias("k")).select("node", "k.*")
    sets = sets_of(docs, ends.join(reps, "node"), seed).dropDuplicates(["node"])
    sets = written(sets, "sets")
    links = verified(first, sets)
    named = written(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "named")
    side = lambda c: named.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    apart = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")
    more = written(verified(written(apart.join(first, ["a", "b"], "left_anti"), "second"), sets).unionByName(across(groups, named, sets)).distinct(), "more")
    if not more.isEmpty():
        named = written(components(links.unionByName(more).select(F.col("a").alias("u"), F.col("b").alias("v"))), "named")
    each = written(sizes.join(named, "node", "left").select("doc_id", "version", "n_shingles", F.coalesce("component", "node").alias("name")), "each")
    # a table of its own, so that both sides of the join are plain exchanges and a component of a third of all rows is split
    least = small(written(each.where("name is not null").groupBy("name").agg(F.min("doc_id").alias("component_id")), "least"), BROADCAST_ROWS)
    return each.join(least, "name", "left").select("doc_id", "version", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "name")


def representatives(docs: DataFrame) -> DataFrame:
    """docs with one document of each group of near duplicates, the one with the smallest key; rows that repeat key and text are one.

    Documents without words are in no group and stay.
    """
    found = written(near_duplicates(docs), "groups")
    first = found.where("name is not null").groupBy("name").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nul"), "doc_id", "version")).alias("k")).select("k.doc_id", "k.version")
    kept = written(first.unionByName(found.where("name is null").select("doc_id", "version").distinct()), "kept").select(F.col("doc_id").isNull().alias("__nul"), F.coalesce("doc_id", F.lit(0)).alias("__id"), F.col("version").alias("__version"))
    mine = docs.withColumns({"__nul": F.col("doc_id").isNull(), "__id": F.coalesce("doc_id", F.lit(0)), "__version": F.xxhash64(F.coalesce("text", F.lit("")))})
    keys = ["__nul", "__id", "__version"]
    return mine.join(kept, keys, "left_semi").dropDuplicates(keys).select(*docs.columns)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
