"""History texts and retrieval candidates against plain versions of their rules."""

import itertools
import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from loomgraph.functions import texts
from loomgraph.operators import context, retries
from loomgraph.plans import queries

DATA = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# --- history -------------------------------------------------------------------


def plain_history(rows, window, limit):
    own = sorted((r for r in rows if r[1] and r[1].strip()), key=lambda r: (-r[0], r[1]))[: max(window, 1)]
    text = "\n\n".join(t for _, t in own) if limit > 0 else ""
    while math.ceil(len(text) / 4) > limit and len(text) > 32:
        text = text[: int(len(text) * 0.85)]
    return text


@pytest.mark.parametrize("window, limit", [(1, 30), (3, 30), (2, 1), (0, 9), (5, 100_000), (2, 0)])
def test_history_text(spark, window, limit):
    rng = random.Random(window * 100 + limit)
    rows = [(k, t, rng.choice([None, "", " \n", "short", "é" * rng.randint(1, 400), "word " * rng.randint(1, 300)])) for k in range(40) for t in range(rng.randint(1, 7))]
    rows += [(None, 1, "no key"), (50, 1, "same"), (50, 1, "same"), (51, 1, None), (52, 1, "x" * 300_000)]
    df = spark.createDataFrame(rows, "run long, turn long, text string").withColumn("tokens", F.lit("clash")).repartition(3)
    got = {r.run: (r.text, r.tokens) for r in context.history_text(df, window, limit, "run", "turn", "text").collect()}
    groups = {}
    for k, t, x in rows:
        if x and x.strip():
            groups.setdefault(k, []).append((t, x))
    want = {k: plain_history(v, window, limit) for k, v in groups.items()}
    assert got == {k: (v, math.ceil(len(v) / 4)) for k, v in want.items()}


def test_history_sends_no_more_than_the_limit(spark):
    df = spark.createDataFrame([(1, 1, "a")], "run long, turn long, text string")
    plan = context.history_text(df, 2, 30, "run", "turn", "text")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("WindowGroupLimit") < plan.rindex("WindowGroupLimit")
    assert context.history_text(df.limit(0), 2, 30, "run", "turn", "text").count() == 0


def test_findings_text(spark):
    rows = [(1, 0, 2, "b", ["f:1-2", "g:3-4"], "high", "direct"), (1, 0, 1, "a", [], None, None), (1, 1, 3, None, None, "low", "expanded")]
    df = spark.createDataFrame(rows, "run int, turn int, finding_id int, claim string, citations array<string>, confidence string, tier string")
    got = {r.turn: r.text for r in context.findings_text(df, "run", "turn").collect()}
    assert got == {0: "[round 0]\n- (?/?) a [no-cite]\n- (high/direct) b [f:1-2, g:3-4]", 1: "[round 1]\n- (low/expanded)  [no-cite]"}


@pytest.mark.parametrize("name", ["history_texts", "findings_told"])
def test_queries_equal_their_sql(spark, name):
    db = duckdb.connect()
    for t in ("conversations", "documents"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = queries.QUERIES[name](spark, DATA)
    want = db.execute(queries.SQL[name])
    assert sorted(got.columns) == sorted(c[0] for c in want.description)
    order = [c[0] for c in want.description]
    rows = want.fetchall()
    assert len(rows) > 0 and sorted(map(tuple, got.select(*order).collect())) == sorted(rows)


# --- what to search for --------------------------------------------------------


def plain_join(parts, chars=220):
    own = list(dict.fromkeys(x for x in (p.strip() for p in parts if p) if x))
    ends = itertools.accumulate((len(p) + 1 for p in own), initial=-1)
    return " ".join(p for p, _ in itertools.takewhile(lambda x: x[1] <= chars, zip(own, itertools.islice(ends, 1, None))))


def plain_hints(hints):
    terms, files = [], []
    for h in filter(None, (x.strip() for x in hints or [] if x)):
        if m := re.fullmatch(r"(.*):\d+-\d+", h, re.DOTALL):
            files.append(m[1])
            terms += [x for x in [m[1].replace("\\", "/").rpartition("/")[2].partition(".")[0]] if x]
        elif m := re.match(r"(?:symbol|search):(.*)", h, re.DOTALL):
            terms.append(m[1].strip())
        else:
            terms += re.findall(r"[A-Za-z_]\w{2,}", h, re.ASCII)[:3]
    return terms, files


def plain_candidates(question, plan, hints, tries):
    base, plan = (question or "").strip(), plan or []
    short = lambda t, n: " ".join((t or "").split())[:n].rstrip()
    parts = list(dict.fromkeys(p for q, ks in plan for p in [short(q, 64), *(short(k, 40) for k in ks[:3])] if p))[:8]
    words = list(dict.fromkeys(w for q, ks in plan for w in [*ks[:3], *re.findall(r"[A-Za-z_]\w{2,}", q or "", re.ASCII)[:4]]))[:12]
    terms, files = plain_hints(hints)
    hint = plain_join(terms + files, 120)
    table = {
        0: {"plan_compact": [base[:80], *parts[:4], hint], "plan_keywords": [base[:60], *words[:8], hint], "question": [base[:100], hint]},
        1: {"retry_hints": [base[:60], hint, *words[:6]], "keywords_only": [*words[:10], hint], "question": [base[:80], hint]},
        2: {"retry_broad": [base[:50], hint], "question_short": [base[:50], hint], "explore_seed": [retries.ANYWHERE, hint]},
    }[min(max(tries or 0, 0), 2)]
    first = {}
    for name, p in table.items():
        if q := plain_join(p):
            first.setdefault(q, name)
    return [(n, q) for q, n in first.items()] or ([("question", base[:100])] if base else [])


def test_joined_query_stops_at_the_first_that_does_not_fit(spark):
    for parts in (["a", "b" * 300, "c"], ["x" * 221], ["x" * 220, "y"], [" a ", "a", "\tb\n", "", None], []):
        assert one(spark, texts.joined_query(F.array(*[F.lit(p).cast("string") for p in parts]).cast("array<string>"))) == plain_join(parts)


def test_candidates(spark):
    rng = random.Random(3)
    pieces = ["where is", "Session.renew", "x", "the quick_brown", "  ", "é", "a\tb", "y" * 90, "token_bucket limit"]
    some = lambda n: " ".join(rng.choices(pieces, k=rng.randint(0, n)))
    hints = ["src/app/user.service.ts:10-20", "a\\b\\c.py:1-2", ":3-4", "symbol: Repo.find ", "search:renew", "look at UserRepo and its_cache now please", "", "  ", None]
    rows = [(i, rng.choice([None, some(6)]), rng.choice([None, [(some(5), rng.choices(["alpha", "beta gamma", "z" * 50, "alpha"], k=rng.randint(0, 5))) for _ in range(rng.randint(0, 5))]]), rng.choice([None, rng.choices(hints, k=rng.randint(0, 5))]), rng.choice([None, -1, 0, 1, 2, 7])) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, question string, plan array<struct<query:string,keywords:array<string>>>, hints array<string>, tries int")
    got = {r.i: [tuple(c) for c in r.c] for r in df.select("i", retries.candidates(F.col("question"), F.col("plan"), F.col("hints"), F.col("tries")).alias("c")).collect()}
    for i, q, p, h, t in rows:
        assert got[i] == plain_candidates(q, p, h, t), (q, p, h, t)


def test_candidates_of_a_table(spark):
    got = queries.QUERIES["retrieval_candidates"](spark, DATA)
    n = spark.read.parquet(f"{DATA}/conversations.parquet").count()
    assert got.select("conv_id", "turn").distinct().count() == n and got.where("query = ''").count() == 0
