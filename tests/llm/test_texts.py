"""Operators 1, 7 and 9 against plain Python."""

import hashlib
import random
import re
import struct
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tarnbeck.llm import decontamination as D
from tarnbeck.llm import fingerprints as O
from tarnbeck.llm import personal_data as P

xxhash = pytest.importorskip("xxhash")
LOW = (1 << 26) - 1


def x64(*parts):
    seed = 42
    for p in parts:
        seed = xxhash.xxh64_intdigest(p if isinstance(p, bytes) else struct.pack(*p) if isinstance(p, tuple) else struct.pack("<q", p), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def order_minhash(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    if not words:
        return ""
    h = [x64(w.encode()) for w in words]
    seen, made = defaultdict(int), []
    for i in range(max(1, len(words) - 2)):
        k = x64(*h[i : i + 3]) >> 26
        made.append(x64(k, ("<i", seen[k])) & ~LOW | (i + 1))
        seen[k] += 1
    out = ""
    for j in range(64):
        rank = {(k * ((j * 37 + 11) % 32 * 2 + 1) % 64) ^ j: k for k in range(64)}
        a, b = (sorted(made, key=lambda x: (rank[(x >> 58) + 32], x)) * 2)[:2]
        if a & LOW > b & LOW:
            a, b = b, a
        out += f"{x64(a & ~LOW, b & ~LOW) & 0xFFFF:04x}"
    return out


def like(a, b):
    return 1.0 if a == b else 0.0 if not a or not b else sum(a[4 * i : 4 * i + 4] == b[4 * i : 4 * i + 4] for i in range(64)) / 64


def test_fingerprints(spark):
    rng = random.Random(2)
    texts = ["", None, "a", "a b", "one two three four", "é ü " * 300, "x " * 2500, "  \n ", "a b c " * 7, " ".join(f"w{rng.randint(0, 50)}" for _ in range(900))]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", O.fingerprint(F.coalesce("text", F.lit(""))).alias("f"))
    for r in df.collect():
        assert r.f == order_minhash(r.text), r.text
    got = {r.id: r for r in O.with_neighbour(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (k, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1] or ""
        assert got[k].given == nxt[: len(t or "") // 4] and got[k].next_fingerprint == order_minhash(nxt)


def test_order_counts(spark):
    w = [f"w{i}" for i in range(400)]
    moved = w[200:] + w[:200]
    a, b = order_minhash(" ".join(w)), order_minhash(" ".join(moved))
    assert 0.2 < like(a, b) < 0.9
    df = spark.createDataFrame([(" ".join(w), " ".join(moved))], "a string, b string")
    assert df.select(O.likeness(O.fingerprint(F.col("a")), O.fingerprint(F.col("b")))).first()[0] == like(a, b)


def test_fingerprint_keys(spark):
    rows = [(None, "n n"), (1, "a b c"), (1, "a b c"), (1, "d e f"), (5, "z")]
    got = O.with_neighbour(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 5 and {r.text for r in got if not r.known} == {"n n"}
    assert O.with_neighbour(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one, = O.with_neighbour(spark.createDataFrame([(7, "abcdefgh")], "doc_id long, text string")).collect()
    assert one.given == "ab"


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for k in P.KINDS:
        for m in re.finditer(PLAIN[k], text, re.ASCII):
            v = m.group()
            d = re.sub("[^0-9]", "", v)
            ok = {"email": True, "ip": all(int(x) <= 255 for x in v.split(".")) if k == "ip" else False, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[k]
            if ok:
                out.append(f"{k}:{m.start()}:{m.end()}")
    return ",".join(out)


PII = [
    "mail a.b+c@x-y.example.org, or é@x.yz and 漢 q@w.e", "ip 10.0.0.1 and 256.1.1.1 and 1.2.3.4.5 and 001.002.003.004 1.1.1.99999999999999999999", "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111 5",
    "call +1 (555) 010-9999 or +12 or +1234567890123456", "", None, "a@b.c" * 500, "+1 234 567 89 " * 300, "no data at all", "1 " * 2000, "🙂🙂 x@y.zz",
]


def test_base_spans(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(PII)], "doc_id long, text string")
    for r in df.select("text", P.listed(P.base_spans(F.col("text"))).alias("s")).collect():
        assert r.s == plain_spans(r.text or ""), r.text


def test_base_spans_of_random_texts(spark):
    rng = random.Random(6)
    bits = ["a", "b.c", "@", ".", "_", "%", "+1", " ", "-", "1", "23", "4111 1111 1111 1111", "9.9", ".9.", "é", "x@y.z", "@@", "a@b", "(555) 0"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 30))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select("text", P.listed(P.base_spans(F.col("text"))).alias("s")).collect():
        assert r.s == plain_spans(r.text), r.text


@pytest.mark.parametrize("n", [10_000, 100_000, 1_000_000])
def test_base_spans_of_long_runs(spark, n):
    """Runs that make a pattern with groups recurse, or try each place of a run anew."""
    runs = {"digits": "7" * n, "dots": "a@b" + ".c" * n, "letters": "x" * n + " q@w.example", "numbers": "1." * n, "plus": "+1" * n, "call": "+1" + " " * n + "x", "at": "@a" * n, "cards": "4 " * n}
    df = spark.createDataFrame([(t,) for t in runs.values()], "text string").repartition(len(runs))
    got = sorted(r.s for r in df.select(F.sha2(P.listed(P.base_spans(F.col("text"))), 256).alias("s")).collect())
    start = n + 1
    want = {"dots": f"email:0:{2 * n + 3}", "letters": f"email:{start}:{start + 11}", "numbers": ",".join(f"ip:{8 * i}:{8 * i + 7}" for i in range(n // 4))}
    assert got == sorted(hashlib.sha256(want.get(k, "").encode()).hexdigest() for k in runs)


def plain_terms(rows, share=P.DISCLOSURE):
    """The disclosing terms of each row, by counting documents for every pair."""
    import math

    ents = [{(s.split(":")[0], t[int(s.split(":")[1]) : int(s.split(":")[2])]) for s in plain_spans(t).split(",") if s} for t in rows]
    terms = [{w for w in re.split(r"[\W_]+", t.lower()) if w} for t in rows]
    out = []
    for e, w in zip(ents, terms):
        hit = set()
        for x in e:
            n_e = sum(x in f for f in ents)
            info = math.log2(len(rows) / n_e)
            for v in w:
                n_t, both = sum(v in u for u in terms), sum(v in u and x in f for u, f in zip(terms, ents))
                if info > 0 and math.log2((both + 0.5) / (n_t + 1)) + info >= share * info:
                    hit.add(v)
        out.append(hit)
    return out


def test_terms_as_by_counting_all_pairs(spark):
    rng = random.Random(12)
    people = [(f"name{chr(97 + i)}x", f"p{i}@mail.example") for i in range(12)]
    rows = []
    for _ in range(400):
        body = rng.choices([f"w{i}" for i in range(60)] + [f"rare{i}" for i in range(400)], k=rng.randint(3, 12))
        for _ in range(rng.randint(0, 2)):
            who, mail = rng.choice(people)
            body += [who] * (rng.random() < 0.9) + [mail] * (rng.random() < 0.6)
        rng.shuffle(body)
        rows.append(" , ".join(body))
    want = plain_terms(rows)
    assert sum(map(bool, want)) > 50
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    inside = [{i for s in plain_spans(t).split(",") if s for i in range(int(s.split(":")[1]), int(s.split(":")[2]))} for t in rows]
    for r in P.with_spans(df).collect():
        places = {(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", r.text) if m.group().lower() in want[r.doc_id] and m.start() not in inside[r.doc_id]}
        assert {(s.start, s.stop) for s in r.spans if s.kind == "term"} == places


def test_terms_that_disclose(spark):
    rows = [(i, f"writer Quillon lives here mail quill@on.example thing{i}") for i in range(6)] + [(i, f"other words here thing{i} lives") for i in range(6, 40)] + [(50, "lone solo@one.example zebra"), (51, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash"))
    got = {r.doc_id: r for r in P.sanitised(df).collect()}
    assert [s.kind for s in got[0].spans] == ["email", "term", "term", "term"]
    assert {s.value for s in got[0].spans if s.kind == "term"} == {"writer", "Quillon", "mail"}
    assert got[0].text == "  lives here  [EMAIL] thing0" and got[50].text == "lone [EMAIL] zebra" and got[51].text is None and got[10].text == rows[10][1]
    assert [s.kind for s in got[50].spans] == ["email"]
    assert P.with_spans(df.limit(0)).count() == 0


def test_terms_of_rare_entities(spark):
    """Entities in one, two and three documents, and two in the same document, disclosed by terms that stand only there."""
    rows = [(i, f"plain words lives here again{'abcdefghij'[i % 10] * 3}") for i in range(600)]
    rows += [(1000, "plain Zebraman lives solo@one.example here"), (1001, "words lives +1 555 010 9999 Ottokar 10.1.2.3 here")]
    rows += [(1010 + i, "plain Duomo lives pair@two.example here") for i in range(2)] + [(1020 + i, f"words Triglav lives trio@three.example here row{'abc'[i] * 4}") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for bound in (P.BROADCAST_ROWS, 0):
        was, P.BROADCAST_ROWS = P.BROADCAST_ROWS, bound
        got = {r.doc_id: (r.text, [s.value for s in r.spans if s.kind == "term"]) for r in P.sanitised(df).collect()}
        P.BROADCAST_ROWS = was
        assert got[1000] == ("plain  lives [EMAIL] here", ["Zebraman"]) and got[1001] == ("words lives [PHONE]  [IP] here", ["Ottokar"])
        assert all(got[1010 + i] == ("plain  lives [EMAIL] here", ["Duomo"]) for i in range(2))
        assert all("Triglav" in got[1020 + i][1] and "lives" in got[1020 + i][0] for i in range(3))
        assert all(got[i] == (rows[i][1], []) for i in range(600)) and len(got) == len(rows)


def test_terms_with_digits_and_short_names(spark):
    rows = [(i, f"plain words lives here {i % 10}") for i in range(600)] + [(1000, "plain Li lives in room B12 code 7741 solo@one.example here 3")]
    got = {r.doc_id: r for r in P.sanitised(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [s.value for s in got[1000].spans if s.kind == "term"] == ["Li", "in", "room", "B12", "code", "7741"]
    assert got[1000].text == "plain  lives      [EMAIL] here 3" and all(got[i].text == rows[i][1] for i in range(600))


def test_personal_data_query(spark, sf):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = P.op7_personal_data(spark, sf).collect()
    assert len(got) == len(text)
    for r in got:
        want = plain_spans(text[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest() and r.spans.startswith(want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(want.count(f"{k}:") for k in P.KINDS)


UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return [w for w in re.split(r"[\W_]+", (t or "").translate(UP)) if w]


def plain_overlaps(docs, items):
    out = set()
    for k, t in docs:
        w = words(t)
        for i, u in items:
            v = words(u)
            width = min(len(v), 13)
            need = width - width * 3 // 13
            for shift in range(-len(v) + 1, len(w)):
                a, b = max(0, -shift), min(len(v), len(w) - shift)
                same = [v[q] == w[q + shift] for q in range(a, b)]
                if width and any(sum(same[s : s + width]) >= need for s in range(len(same) - width + 1)):
                    out.add((k, i, a + shift))
    return out


def test_overlaps(spark):
    rng = random.Random(9)
    vocab = [f"v{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocab, k=n))) for i, n in enumerate((30, 20, 13, 12, 9, 6, 4, 2, 1, 15))] + [(20, ""), (21, None)]
    docs = []
    for k in range(60):
        body = rng.choices(vocab, k=rng.randint(0, 80))
        i, item = rng.choice(items[:10])
        piece = item.split()
        for _ in range(rng.randint(0, 4)):
            piece[rng.randrange(len(piece))] = f"s{rng.randint(0, 999)}"
        at = rng.randint(0, len(body))
        docs.append((k, " ".join([*body[:at], *piece, *body[at:]]).title() + "."))
    docs += [(100, None), (101, ""), (102, "...")]
    want = plain_overlaps(docs, items)
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame([*docs, docs[0]], "doc_id long, text string")
    for limit in (D.BROADCAST_ROWS, 0):
        got = [(r.doc_id, r.item_id, r.doc_start) for r in D.overlaps(d, b, broadcast_rows=limit).collect()]
        assert set(got) == want and len(got) == len(want)
    kept = {r.doc_id for r in D.decontaminated(d, b).collect()}
    assert kept == {k for k, _ in docs} - {k for k, _, _ in want}


def test_masks_hit_every_window():
    import itertools

    for gone in itertools.combinations(range(13), 3):
        assert any(all(m[j] == "0" or s + j not in gone for j in range(len(m))) for m in D.MASKS for s in range(13 - len(m) + 1))


def test_overlaps_of_nothing(spark):
    none, some = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert D.overlaps(some, none).count() == 0
    assert D.overlaps(some.limit(0), some.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_overlaps_in_long_texts_and_beside_clashing_columns(spark):
    item = " ".join(f"b{i}" for i in range(20))
    long_ = "filler words " * 100_000 + item + " rest" * 100_000
    d = spark.createDataFrame([(1, long_), (2, "short"), (None, item), (None, item)], "doc_id long, text string").withColumn("item", F.lit("clash")).withColumn("seed", F.lit(1)).withColumn("key", F.lit("k"))
    b = spark.createDataFrame([(9, item)], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.doc_start, r.n_equal) for r in D.overlaps(d, b).collect()}
    assert got == {(1, 9, 200_000, 20), (None, 9, 0, 20)}
    kept = D.decontaminated(d, b)
    assert kept.columns == d.columns and [r.doc_id for r in kept.collect()] == [2]


def test_overlapping_spans_are_rewritten_once(spark):
    # a card that a phone number begins with, and two kinds that share their end
    text = "+4111 1111 1111 1111 and +1.2.3.4567 10.2.3.4"
    df = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string").withColumn("spans", F.lit("clash"))
    got = P.sanitised(df).collect()
    assert len(got) == 2 and got[0] == got[1]
    spans = [(s.kind, s.start, s.stop) for s in got[0].spans if s.kind != "term"]
    assert ",".join(f"{k}:{a}:{b}" for k, a, b in spans) == plain_spans(text)
    covered = {i for _, a, b in spans for i in range(a, b)}
    assert not any(text[a:b] in got[0].text for _, a, b in spans) and covered


def test_short_texts_have_many_different_pairs():
    rng = random.Random(1)
    n = []
    for _ in range(40):
        f = order_minhash(" ".join(f"w{rng.randint(0, 10**9)}" for _ in range(20)))
        n.append(len({f[i : i + 4] for i in range(0, 256, 4)}))
    assert sum(n) / len(n) > 40  # of 64; starting points in one order give 16


def test_rewriting_as_span_by_span(spark):
    rng = random.Random(21)
    rows = []
    for n in (1, 7, 40, 200):
        text = "".join(rng.choice("ab \n🙂é") for _ in range(n * 60))
        spans = []
        for _ in range(n):
            a = rng.randrange(len(text))
            spans.append((rng.choice(["email", "ip", "term"]), a, min(len(text), a + rng.randint(1, 90)), ""))
        rows.append((text, spans))
    df = spark.createDataFrame(rows, f"text string, spans {P.SPAN}")
    for r in df.select("text", "spans", P.rewritten(F.col("text"), F.col("spans")).alias("got"), P.outside(F.filter("spans", lambda s: s["kind"] != "term"), F.filter("spans", lambda s: s["kind"] == "term")).alias("rest")).collect():
        out, at = "", 0
        for s in sorted(r.spans, key=lambda s: (s.start, -s.stop, s.kind)):
            if s.start >= at:
                out += r.text[at : s.start] + ("" if s.kind == "term" else f"[{s.kind.upper()}]")
            at = max(at, s.stop)
        assert r.got == out + r.text[at:]
        base = [s for s in r.spans if s.kind != "term"]
        want = [(s.start, s.stop) for s in r.spans if s.kind == "term" and not any(b.start <= s.start and s.stop <= b.stop for b in base)]
        assert [(s.start, s.stop) for s in r.rest] == sorted(want)


def test_a_text_of_very_many_spans(spark):
    n = 60_000
    text = " ".join(f"a{i}@b.example and" for i in range(n))
    r = P.sanitised(spark.createDataFrame([(1, text), (2, "plain")], "doc_id long, text string")).where("doc_id = 1").first()
    assert len(r.spans) == n and r.text == " ".join(["[EMAIL] and"] * n)


def test_removed(spark):
    rows = [(1, "mail a@b.example and +49 30 1234567 or c@d.example"), (2, "nothing"), (3, None), (4, "x@y.example")]
    marked = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", P.base_spans(F.col("text")))
    got = {r.kind: (r.documents, r.spans, r.characters, round(r.share, 9)) for r in P.removed(marked).collect()}
    total = sum(len(t or "") for _, t in rows)
    assert got == {"email": (2, 3, 33, round(33 / total, 9)), "phone": (1, 1, 14, round(14 / total, 9))}
    assert P.removed(marked.limit(0)).collect() == []
