"""Running values, log windows and change batches, piece by piece, against plain
versions; plans without a group as large as a key."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from quillgraph.functions.scan import running
from quillgraph.operators import logs
from quillgraph.streaming import watch


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("piece", [1, 3, 10_000])
def test_running_values(spark, piece):
    rnd = random.Random(piece)
    rows = [(k, n, rnd.choice([None, *range(-5, 6)])) for k in ("a", "b", None) for n in rnd.sample(range(200), 60)]
    df = spark.createDataFrame(rows, "k string, n long, v long").repartition(5).withColumn("_v_s", F.lit(1))
    got = {(r["k"], r["n"]): (r["s"], r["g"], r["l"]) for r in running(df.drop("_v_s"), "k", ["n"], {"s": ("sum", F.col("v")), "g": ("max", F.col("v")), "l": ("min", F.col("v"))}, piece).collect() if r["k"]}
    for k, n, _ in rows:
        if k:
            before = [v for a, m, v in rows if a == k and m < n and v is not None]
            assert got[k, n] == ((sum(before), max(before), min(before)) if before else (None, None, None))


def plain_blocks(n, hits, context):
    out = []
    for m in hits:
        a, b = max(1, m - context), min(n, m + context)
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]), out[-1][2] + 1)
        else:
            out.append((a, b, 1))
    return out


@pytest.mark.parametrize("context", [0, 3])
def test_blocks_and_text_of_one_long_log(spark, context):
    rnd = random.Random(context)
    n = 400
    hits = sorted(rnd.sample(range(1, n + 1), 40))
    lines = spark.createDataFrame([(1, i, ("hit " if i in hits else "no ") + "x" * rnd.randint(0, 9)) for i in range(1, n + 1)] + [(2, 1, "no")], "log_id long, line_number long, text string").repartition(7)
    test = F.col("text").startswith("hit")
    for piece in (4,):
        found = logs.blocks(lines, test, context, piece)
        assert [(r["start"], r["stop"], r["n_matches"]) for r in found.orderBy("start").collect()] == plain_blocks(n, hits, context)
        whole = logs.render(lines, found, 1 << 20, piece).count()
        assert whole == sum(b - a + 1 for a, b, _ in plain_blocks(n, hits, context))
        for budget in (3, 11, 57):
            text = logs.result(lines, found, budget).filter("log_id = 1").first()
            want, rest = "", budget
            texts = {r["line_number"]: r["text"] for r in lines.filter("log_id = 1").collect()}
            for a, b, _ in plain_blocks(n, hits, context):
                for i in range(a, b + 1):
                    gap = "" if not want else "\n\n" if i == a else "\n"
                    full = f"{i}| {texts[i]}"
                    room = rest - len(gap)
                    if len(full) > room:
                        want += gap + full[: room - 3] + "..." if room > 3 else ""
                        rest = -1
                        break
                    want, rest = want + gap + full, room - len(full)
                if rest < 0:
                    break
            assert text["body"] == want, (piece, budget)


def test_a_log_is_cut_into_pieces(spark):
    lines = spark.range(1, 50_001).select(F.lit(1).alias("log_id"), F.col("id").alias("line_number"), F.lit("hit").alias("text"))
    found = logs.blocks(lines, F.col("line_number") % 100 == 0, 3)
    assert found.count() == 500
    kept = logs.capture(lines, 1 << 30, 100_000)
    assert kept.count() == 33_334 and [r["line_number"] for r in kept.filter("cut").collect()] == [33_334]
    import re

    for line in plan(logs.capture(lines, 1 << 30, 10)).split("\n"):
        if "hashpartitioning(log_id" in line:  # lines move by piece, pieces of pieces by log
            assert re.search(r"_piece|_far|FLOOR|_t_", line), line


@pytest.mark.parametrize("delay", [1, 50])
def test_batches_of_one_key(spark, delay):
    rnd = random.Random(delay)
    start = datetime.datetime(2024, 1, 1)
    rows = [(k, start + datetime.timedelta(milliseconds=rnd.randint(0, 400)), i) for i, k in enumerate(["a"] * 150 + ["b"] * 5 + ["c"])] + [(None, start, 900), ("a", None, 901)]
    got = {r["m"]: r["batch"] for r in watch.batches(spark.createDataFrame(rows, "k string, ts timestamp, m int").repartition(4), "k", delay_ms=delay).collect()}
    want = {}
    for k in "abc":
        opened, n = None, 0
        for _, t, m in sorted((r for r in rows if r[0] == k and r[1]), key=lambda r: r[1]):
            if opened is None or t > opened + datetime.timedelta(milliseconds=delay):
                opened, n = t, n + 1
            want[m] = n
    assert got == want
