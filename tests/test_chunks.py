from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colloquy.operators import chunks as C


def model_windows(text, size, overlap):
    size = max(1, size)
    overlap = min(max(0, overlap), size - 1)
    out, start = [], 0
    while True:
        out.append(text[start : start + size])
        if start + size >= len(text):
            return out
        start += size - overlap


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab王\n ", max_size=40), min_size=1, max_size=8), st.integers(0, 9), st.integers(-1, 12))
def test_windows(spark, texts, size, overlap):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, text string, chunk_text0 string")
    got = {}
    for r in C.windows(df, size=size, overlap=overlap).orderBy("id", "chunk").collect():
        got.setdefault(r["id"], []).append(r["chunk_text"])
    assert got == {i: model_windows(t, size, overlap) for i, t in enumerate(texts)}


def test_pack(spark):
    got = spark.range(1).select(C.pack(F.array(*map(F.lit, (3, 3, 3, 5, 9, 1))), 6).alias("g"), C.pack(F.array().cast("array<int>"), 6).alias("e")).first()
    assert got["g"] == [0, 0, 1, 2, 3, 4] and got["e"] == []


def model_lines(text, budget):
    out, cur, used = [], [], 0
    for line in text.split("\n"):
        cost = len(line) + 1
        if cur and used + cost > budget:
            out.append("\n".join(cur))
            cur, used = [], 0
        cur.append(line)
        used += cost
    return [*out, "\n".join(cur)]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab\n", max_size=30), min_size=1, max_size=6), st.integers(1, 12))
def test_line_chunks_join_to_the_text(spark, texts, budget):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in C.line_chunks(df, budget=budget, cost=F.length).orderBy("id", "chunk").collect():
        got.setdefault(r["id"], []).append(r["chunk_text"])
    assert got == {i: model_lines(t, budget) for i, t in enumerate(texts)}
    assert all("\n".join(got[i]) == t for i, t in enumerate(texts))


def test_budgets_and_partials(spark):
    r = spark.range(1).select(C.map_budget(F.lit(224)).alias("a"), C.map_budget(F.lit(4000)).alias("b"), C.group_partials(F.array(*map(F.lit, ("aaa", "bb", "cccccccc", "d"))), 7).alias("g"), C.fits(F.lit(32768 - 96 - 10), F.lit(10)).alias("f")).first()
    assert (r["a"], r["b"], r["g"], r["f"]) == (2265, 512, [["aaa", "bb"], ["cccccccc"], ["d"]], True)


def test_fold(spark):
    df = spark.createDataFrame([(1, ["aaaa", "bbbb", "cccc"]), (2, ["x"]), (3, [])], "id int, p array<string>")
    short = lambda g: F.substring(F.array_join(g, ""), 1, 2)
    got = {r["id"]: r["p"] for r in C.fold_to_fit(df, "p", 10, "\n\n", short).collect()}
    assert got == {1: ["aa", "cccc"], 2: ["x"], 3: []}


def test_fold_by_calls_made_once_for_each_group(spark):
    """An outside model folds; what it is asked and how often is the same as in a loop on one machine."""
    df = spark.createDataFrame([(1, ["aaaa", "bbbb", "cccc", "dddd", "eeee"]), (2, ["x"]), (3, []), (4, None), (5, ["p" * 9, "q" * 9])], "id int, p array<string>")
    calls = spark.sparkContext.accumulator(0)

    def model(groups):
        @F.udf("string")
        def one(g):
            calls.add(1)
            return "".join(x[0] for x in g) + "!"

        return groups.withColumn("text", one.asNondeterministic()("group"))

    got = {r["id"]: r["p"] for r in C.fold_to_fit(df, "p", 10, "\n\n", reduce_rows=model).collect()}
    # round 1: (aaaa bbbb) (cccc dddd) (eeee); round 2: "ab!" "cd!" fit with 2 between, "eeee" alone: 3 + 2 + 3 + 2 + 4 is above 10
    assert got == {1: ["ac!", "eeee"], 2: ["x"], 3: [], 4: None, 5: ["p" * 9, "q" * 9]} and calls.value == 3
