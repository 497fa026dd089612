"""Hand cases of rules that SQL beside a query might repeat wrongly."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quirelight import plans
from quirelight.functions import scalars as S
from quirelight.functions import text as T
from quirelight.operators import assignment
from quirelight.operators import geometry as G
from quirelight.operators.assignment import exclusive_choices
from quirelight.operators.chains import chain_places
from quirelight.plans import shelves, tables


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    ("text", "plain"),
    [("Žižek Łódź Čapek", "zizek odz capek"), ("ﬁne Straße ①", "fine strasse 1"), ("é é ü ñ ç", "e e u n c"), ("İstanbul", "istanbul"), ("ＡＢＣ", "abc")],
)
def test_folding_is_by_decomposition(spark, text, plain):
    assert one(spark, T.plain_title(F.lit(text))) == plain


def test_slugs_lose_every_accent(spark):
    assert one(spark, S.long_slug(F.lit("Größe: Žižek & Čapek"))) == "groesse-zizek-capek"


@pytest.mark.parametrize(
    ("text", "cents"),
    [("t 29,80", 2980), ("Art 29,80", None), ("€ 18,–", 1800), ("€ 18,—", 1800), ("17,90 €", 1790), ("17,90  €", None), ("17,95 Euro", None), ("1234,50 €", 23450), ("1.234,50 €", 123450), ("5 € und EUR 7,50", 750), ("3,20 € oder € 4,10", 410)],
)
def test_printed_prices(spark, text, cents):
    assert one(spark, T.price_cents(F.lit(text))) == cents


@pytest.mark.parametrize(("typed", "address"), [("\t A@B.example\r\n", "a@b.example"), (" x@y.example﻿", "x@y.example"), (None, "")])
def test_addresses_lose_all_white_space_at_the_ends(spark, typed, address):
    assert one(spark, T.normal_email(F.lit(typed).cast("string"))) == address


def alike(rows, bound, leeway):
    """(id -> first kept one like it), one after the other."""
    kept, out = {}, {}
    for i, grp, e, shape in sorted(rows):
        first = next((k for k, v, s in kept.get(grp, []) if abs(s - shape) <= leeway * max(s, shape) and (sum((a - b) ** 2 for a, b in zip(v, e, strict=True)) / len(e)) ** 0.5 < bound), None)
        out[i] = first
        if first is None:
            kept.setdefault(grp, []).append((i, e, shape))
    return out


def test_pictures_are_like_kept_ones_only(spark):
    kind = "id long, grp int, e array<double>, shape double"
    found = G.first_of_alike(spark.createDataFrame([(1, 1, [0.0], 1.0), (2, 1, [0.09], 1.0), (3, 1, [0.18], 1.0), (4, 1, [0.0], 1.2), (5, 2, [0.0], 1.0)], kind), "id", "grp", "e", 0.1, "shape", 0.03)
    assert {r["id"]: r["first"] for r in found.collect()} == {1: None, 2: 1, 3: None, 4: None, 5: None}
    rng = random.Random(6)
    rows = [(i, rng.randint(1, 3), [rng.randint(0, 12) / 10, rng.randint(0, 3) / 10], rng.choice((1.0, 1.02, 1.5))) for i in range(300)]
    found = G.first_of_alike(spark.createDataFrame(rows, kind), "id", "grp", "e", 0.15, "shape", 0.03, block=16)
    assert {r["id"]: r["first"] for r in found.collect()} == alike(rows, 0.15, 0.03)


def test_choices_in_turn(spark):
    rng = random.Random(7)
    pairs = [(a, b, rng.randint(0, 5)) for a in range(40) for b in range(40) if rng.random() < 0.3] + [(100 + a, 200, 1) for a in range(3)]
    taken, expected = set(), {}
    for a in sorted({p[0] for p in pairs}, key=lambda a: (a % 7, a)):
        free = [(liking, b) for x, b, liking in pairs if x == a and b not in taken]
        if free:
            expected[a] = min(free)[1]
            taken.add(expected[a])
    df = spark.createDataFrame(pairs, "a long, b long, liking int")
    found = exclusive_choices(df, ["a"], ["b"], [(F.col("a") % 7).alias("turn")], [F.col("liking")])
    assert {r.a: r.b for r in found.collect()} == expected
    assert exclusive_choices(df.limit(0), ["a"], ["b"], [F.col("a").alias("turn")], [F.col("liking")]).count() == 0


def test_places_along_chains(spark):
    rng = random.Random(8)
    rows = []
    for g in range(6):
        n = 40
        rows += [(g, i, rng.choice([None, rng.randrange(n), i + 1 if i + 1 < n else None, 999]), rng.random() < 0.2, rng.randint(0, 9)) for i in range(n)]
    rows += [(9, i, i + 1, i == 0, 0) for i in range(300)] + [(10, 0, 1, False, 1), (10, 1, 0, False, 0)]
    expected = {}
    for g in {r[0] for r in rows}:
        own = {r[1]: r for r in rows if r[0] == g}
        order, seen = [], set()
        by_rank = sorted(own.values(), key=lambda r: (r[4], r[1]))
        for start in [r for r in by_rank if r[3]]:
            at = start
            while at and at[1] not in seen:
                seen.add(at[1])
                order.append(at[1])
                at = own.get(at[2])
        order += [r[1] for r in by_rank if r[1] not in seen]
        expected |= {(g, i): k for k, i in enumerate(order, 1)}
    df = spark.createDataFrame(rows, "g long, id long, following long, begins boolean, pos int")
    found = chain_places(df, "g", "id", "following", F.col("begins"), ["pos"]).collect()
    assert {(r.g, r.id): r.place for r in found} == expected


@pytest.mark.parametrize("prices", [[100.5, 179.0], [280.5], [101.5, 178.0]])
def test_half_prices_go_to_the_even_number(spark, tmp_path, prices):
    rows = [(1, k, k, k, "A", p) for k, p in enumerate(prices)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_returnflag string, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    sql = plans.oracle_sql()["article_confidence"].replace("FROM lineitem", f"FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert [tuple(r) for r in plans.queries()["article_confidence"](spark, str(tmp_path)).collect()] == duckdb.sql(sql).fetchall()


def test_subscriptions_meet_blocks_of_issues(spark):
    readers = spark.range(100).selectExpr("id AS reader", "'p' AS publication")
    lists = spark.createDataFrame([("p", 0, [1, 2, 3]), ("q", 0, [4])], "publication string, block int, issues array<long>")
    met = shelves._readers_and_blocks(readers, lists)
    assert met.count() == 100
    assert met.select("reader", F.explode("issues")).distinct().count() == 300
    # nothing is made distinct, sorted or shuffled above the pairs
    plan = plans.queries()["readable_issues"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("Union")


def test_tasks_do_not_grow_with_the_order_lines(spark, monkeypatch):
    monkeypatch.setattr(tables, "LINES_A_TASK", 100)
    lines = tables._by_order(spark, "/root/testdata/sf0.001")
    assert lines.rdd.getNumPartitions() >= lines.count() / 100


def test_choices_are_dealt_to_tasks_by_their_number(spark, monkeypatch):
    pairs = spark.createDataFrame([(a, b, (a * 7 + b * 3) % 11) for a in range(12) for b in range(9)], "a long, b long, far long")
    choose = lambda: sorted(map(tuple, exclusive_choices(pairs, ["a"], ["b"], [F.col("a").alias("turn")], [F.col("far")]).collect()))
    expected, widths = choose(), []
    monkeypatch.setattr(assignment, "PAIRS_A_TASK", 10)
    cut = assignment.cut_lineage
    monkeypatch.setattr(assignment, "cut_lineage", lambda df: widths.append(df.rdd.getNumPartitions()) or cut(df))
    assert choose() == expected
    assert max(widths) >= 108 // 10


def test_an_issue_without_a_key_is_read_once(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    part = spark.read.parquet(f"{sf}/part.parquet")
    gone = part.filter("p_size % 3 != 0 AND p_size % 5 != 0").withColumn("p_partkey", F.lit(None).cast("long"))
    part.unionByName(gone).write.parquet(f"{tmp_path}/part.parquet")
    for name in ("customer", "orders", "lineitem"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("part", "customer", "orders", "lineitem"):
        duckdb.sql(f"CREATE OR REPLACE TEMP VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    expected = duckdb.sql(plans.oracle_sql()["readable_issues"]).fetchall()
    found = plans.queries()["readable_issues"](spark, str(tmp_path)).select("reader", "issue").collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))


def test_shelves_are_those_of_a_whole_sort(spark, monkeypatch):
    monkeypatch.setattr(shelves, "SPAN", 4)
    shown = spark.createDataFrame([("p", i) for i in range(1, 30) if i % 5] + [("q", 2)], "publication string, issue long")
    titles = spark.createDataFrame([(i, f"t{i}") for i in range(40)] + [(7, "again")], "issue long, title string")
    running = spark.createDataFrame([(1, "p"), (2, "p"), (3, "q"), (4, "none")], "reader long, publication string")
    extra = spark.createDataFrame([(1, 5), (1, 35), (1, 0), (2, 10), (3, 30), (4, 8), (5, 9), (5, 3), (5, 77)], "reader long, issue long")
    seen = spark.createDataFrame([(1, 7, 3, 1.0), (1, 35, 9, 2.0), (1, 12, None, 3.0), (2, 29, 1, 4.0), (5, 9, 2, 5.0), (3, 1, 1, 6.0)], "reader long, issue long, t long, page double")
    seen = seen.select("reader", "issue", F.timestamp_seconds("t").alias("read_at"), "page")
    rows = [tuple(r) for r in extra.unionByName(running.join(shown, "publication").select("reader", "issue")).join(titles, "issue").join(seen, ["reader", "issue"], "left").select("reader", "issue", "title", "read_at", "page").collect()]
    late = lambda r: -r[3].timestamp() if r[3] else 1
    expected = [(*r, n) for k in range(1, 6) for n, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (late(r), r[1], r[2])), 1)]
    found = shelves._shelves(extra, running, shown, titles, seen)
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, expected))
    # the pairs of readers and issues are not sorted
    assert found._jdf.queryExecution().optimizedPlan().toString().lstrip().startswith("Union")
