import math
import time
from fractions import Fraction
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from tarnbeck.functions import programs, stats
from tarnbeck.functions import text as T
from tarnbeck.operators import ranks


def one(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_whole_number_equals_the_parser(spark):
    each = ("0", "76", "-5", "-0", "076", "+7", " 8", "8 ", "1.5", "1e3", '"9"', "", "null", "true", "[1]", '{"k": 1}', "2147483647", "2147483648", "-2147483648", "٣", '7, "k": 8', '7, "j": 8', '7} {"k": 8', "7}")
    rows = [('{"k": ' + x + "}",) for x in each] + [(x,) for x in (None, "", "{", "7", '{"k": ', '{"k": }', '{"k":7}', '{"k": 7} ', ' {"k": 7}', '{"k": 7', '{"j": 7}', '{"j": 1, "k": 7}', '{"K": 7}', '[{"k": 7}]')]
    got = one(spark, rows, "a string", F.col("a"), T.whole_number(F.col("a"), "k"), F.get_json_object("a", "$.k").try_cast("int"))
    assert [g for g in got if g[1] != g[2]] == [] and [x for _, x, _ in got][:3] == [0, 76, -5]


def test_whole_number_takes_a_fraction_of_the_parser(spark):
    df = spark.range(0, 1_000_000, 1, 1).select(F.concat(F.lit('{"k": '), F.col("id") % 100, F.lit("}")).alias("a"))

    def took(c):
        began = time.time()
        assert df.agg(F.sum(c)).first()[0] == 49_500_000
        return time.time() - began

    plain, parsed = T.whole_number(F.col("a"), "k"), F.get_json_object("a", "$.k").try_cast("int")
    took(plain), took(parsed)
    assert min(took(plain), took(plain)) < 0.7 * min(took(parsed), took(parsed))


def test_tokens_and_jaccard(spark):
    rows = [("How many rows are there in the table", "rows table"), ("", ""), ("the of a", None), (None, "x")]
    got = one(spark, rows, "a string, b string", T.tokens(F.col("a")), T.jaccard(T.tokens(F.col("a")), T.tokens(F.col("b"))))
    assert [g[0] for g in got] == [["rows", "table"], [], [], []]
    assert [g[1] for g in got] == [1.0, 0.0, 0.0, 0.0]


def test_ngrams_see_order(spark):
    a, b = T.char_ngrams(F.col("a")), T.char_ngrams(F.col("b"))
    (t, n), = one(spark, [("by country total", "total by country")], "a string, b string", T.jaccard(T.tokens(F.col("a")), T.tokens(F.col("b"))), T.jaccard(a, b))
    assert t == 1.0 and n < 1.0
    assert one(spark, [("",)], "a string", T.char_ngrams(F.col("a"))) == [(["  "],)]


@pytest.mark.parametrize("answer,want", [
    ("Wii Sports", ("exact_short", "Wii Sports")), ("Yes", ("exact_bool", "yes")), ("$1,234.50", ("numeric", "1234.50")), ("12%", ("numeric", "12")),
    ("Not stated", None), ("5 km", None), ("", None), (None, None), ("x" * 61, None), ("unknown", None),
])
def test_classify(spark, answer, want):
    got = spark.createDataFrame([(answer,)], "a string").select(T.classify(F.col("a")).alias("c")).first().c
    assert (tuple(got) if got else None) == want


def test_tolerance(spark):
    rows = [("numeric", "453"), ("numeric", "1.5"), ("numeric", "8.89663104713"), ("exact_short", "x")]
    got = [g[0] for g in one(spark, rows, "m string, v string", T.tolerance(F.col("m"), F.col("v")))]
    assert got == [0.05, pytest.approx(0.01), pytest.approx(1e-4), 0.0]


@pytest.mark.parametrize("q,family", [
    ("How many rows have a price above 3?", "count"), ("What is the accuracy of the random forest?", "ml_fit"), ("What is the p-value of the t-test?", "stat_test"),
    ("Which country has the most common flag?", "argmax"), ("What is the mean age per team?", "groupby"), ("Mean of x", "agg"), ("zzz", "other"), (None, "other"),
])
def test_family(spark, q, family):
    assert one(spark, [(q,)], "q string", T.op_family(F.col("q"))) == [(family,)]


def test_keys(spark):
    rows = [("0000/324/324276.ipynb_qa_3",), ("ja_0000_324_324276.ipynb_qa_3",)]
    assert {g[0] for g in one(spark, rows, "a string", T.source_row_key(F.col("a")))} == {"0000_324_324276.ipynb_qa_3"}
    assert one(spark, [("a_qa_b_qa_7",), ("x",)], "a string", T.notebook(F.col("a"))) == [("a_qa_b",), ("x",)]
    assert one(spark, [(["in/T.csv", "t.CSV", "b.csv"],)], "f array<string>", T.file_key(F.col("f"))) == [(["b.csv", "t.csv"],)]


def test_answers_agree(spark):
    rows = [("1.0", "1"), ("a b", "A  b!"), ("1", "2"), ("1d", "1"), (None, "")]
    assert [g[0] for g in one(spark, rows, "a string, b string", T.answers_agree(F.col("a"), F.col("b")))] == [True, True, False, False, True]


def test_leaks(spark):
    rows = [("12345", "the value is 12,345 there"), ("abc", "abc abc"), ("0.8277", "close to 0.82771"), ("12345", "12 or 123456")]
    got = [g[0] for g in one(spark, rows, "a string, p string", T.leaks(F.col("a"), F.col("p")))]
    assert got == [["answer-substring"], [], ["answer-substring"], ["answer-substring"]]
    assert one(spark, [("1234.0", "about 1234 in all")], "a string, p string", T.leaks(F.col("a"), F.col("p"))) == [(["answer-numeric:1234"],)]


def test_scrub(spark):
    rows = [("open /home/alice/work/t.csv now",), ("cd /home/alice/work",), ("key sk-or-v1-abcdefgh12345678",), ("/home/user/input/t.csv",), ("kaggle/datasets/o/n/versions/3/t.csv",), (None,)]
    got = one(spark, rows, "a string", T.scrub(F.col("a")), T.machine_leaks(T.scrub(F.col("a"))))
    assert [g[0] for g in got] == ["open ./input/t.csv now", "cd ./input", "key [secret]", "/home/user/input/t.csv", "./input/t.csv", ""]
    assert all(g[1] == [] for g in got)


def test_replies(spark):
    rows = [('ok {"answerable": true, "unambiguous": "False", "reason": "r"} end',), ("nothing",), ("{broken",)]
    got = [g[0] for g in one(spark, rows, "a string", T.verdict(F.col("a")))]
    assert got[0].answerable is True and got[0].unambiguous is False and got[0].determinate is None and got[0].error is None
    assert got[1].error == got[2].error == "no object in reply"
    assert one(spark, [("a\n b \n\n",), ("",)], "a string", T.last_line(F.col("a"))) == [("b",), ("",)]
    assert one(spark, [("x ```python\n1\n``` y ```\n2\n```",), ("z",)], "a string", T.extract_code(F.col("a"))) == [("2\n",), ("z",)]
    assert one(spark, [("ANSWER: 5",), ("5",)], "a string", T.strip_prefix(F.col("a"))) == [("5",), ("5",)]
    assert one(spark, [("it's",), ("a\nb",), ("-n",)], "a string", T.submission(F.col("a"))["refusal"]) == [(None,), ("several lines",), ("looks like a flag",)]


def test_wilson(spark):
    rows = [(0, 0), (0, 150), (150, 150), (75, 150)]
    got = [g[0] for g in one(spark, rows, "s long, n long", stats.wilson(F.col("s"), F.col("n")))]
    assert tuple(got[0]) == (0.0, 0.0) and got[1].low == 0.0 and got[2].high <= 1.0 and got[3].low < 0.5 < got[3].high


def test_kappa(spark):
    rows = [(1.0, 0.5, 0.5), (0.9, 0.5, 0.5), (0.0, 0.5, 0.5), (1.0, 1.0, 1.0), (None, None, None)]
    got = [g[0] for g in one(spark, rows, "p double, a double, b double", stats.kappa(F.col("p"), F.col("a"), F.col("b")))]
    assert got == [1.0, pytest.approx(0.8), -1.0, 0.0, 0.0]


def test_sign_test(spark):
    rows = [(11, 27), (10, 16), (3, 13), (0, 0)]
    got = [g[0] for g in one(spark, rows, "d long, u long", stats.sign_test(F.col("d"), F.col("u")))]
    assert [round(g, 3) for g in got[:3]] == [0.014, 0.327, 0.021] and got[3] is None


def test_sign_test_of_many_pairs(spark):
    """Time in proportion to the pairs: with each term's logarithms summed from the start, each of the two rows of 100,000 would take 5 * 10**9 steps."""
    rows = [(99_800, 100_200), (100_000, 100_000), (6_001, 6_000), (7_050, 7_550), (0, 150_000), (1, 0), (2, 1)]
    began = time.time()
    got = [g[0] for g in one(spark, rows, "d long, u long", stats.sign_test(F.col("d"), F.col("u")))]
    assert time.time() - began < 100
    log_tail = lambda n, k: (math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)) for i in range(k + 1))
    assert got[:2] == [pytest.approx(min(1.0, 2 * sum(log_tail(d + u, min(d, u)))), rel=1e-6) for d, u in rows[:2]]
    assert got[2:] == [pytest.approx(float(min(1, Fraction(2 * sum(accumulate(range(min(d, u)), lambda c, i: c * (d + u - i) // (i + 1), initial=1)), 2 ** (d + u)))), rel=1e-11, abs=1e-300) for d, u in rows[2:]]


def test_nearest_ranks_equal_the_gathered_form(spark):
    rows = [("a", float(i % 7)) for i in range(50)] + [("b", 1.0), ("c", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.q for r in ranks.nearest_ranks(df, ["k"], "v", {"q": 0.75}).collect()}
    want = {r.k: r.q for r in df.where("v is not null").groupBy("k").agg(stats.nearest_rank(F.col("v"), 0.75).alias("q")).collect()}
    assert got == want


def test_bootstrap(spark):
    df = spark.createDataFrame([("one", 0.5), ("many", 0.0), ("many", 1.0), ("many", 1.0), ("none", None)], "k string, v double")
    got = {r.k: r for r in stats.percentile_bootstrap(df, "k", "v", 500).collect()}
    assert set(got) == {"one", "many"} and got["one"].low == got["one"].high == 0.5
    assert got["many"].low <= got["many"].mean <= got["many"].high
    assert got["many"] == {r.k: r for r in stats.percentile_bootstrap(df, "k", "v", 500).collect()}["many"]


def test_programs(spark):
    src = "import pandas as pd\ndf = pd.read_csv('input/t.csv')\nx = df[df['city'] == 'Oslo']['price'].mean()\nprint(x)\n"
    df = spark.createDataFrame([(src, "Oslo"), ("not ( python", "x"), (None, None)], "s string, a string")
    got = df.select(programs.method_names("s").alias("m"), programs.code_facts("s").alias("f"), programs.strip_output("s").alias("q"), programs.redact_literals("s", "a").alias("r"), programs.is_program("s").alias("p")).collect()
    assert got[0].m == ["mean"] and got[0].f.files == ["t.csv"] and got[0].f.columns == ["price", "city"] and got[0].f.filters == ["city == 'Oslo'"]
    assert "print" not in got[0].q and "Oslo" not in got[0].r and [g.p for g in got] == [True, False, False]
