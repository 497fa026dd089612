"""Hints in articles against loops, and points of products by hand."""

import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from quirelight import plans
from quirelight.functions import linkage as L
from quirelight.operators import hints as H
from quirelight.operators import relational as R
from quirelight.plans.matching import _hints_and_products, article_blocks

SF = "/root/testdata/sf0.001"
PRICE = (r"(?:€|EUR|(?<![A-Za-zÄÖÜäöüß])t)\s?(\d{1,3}(?:\.\d{3})*),(\d{2}|[–—-])", r"(\d{1,3}(?:\.\d{3})*),(\d{2}|[–—-])\s?(?:€|EUR)")


def cents(text):
    m = re.search(PRICE[0], text) or re.search(PRICE[1], text)
    return m and int(m[1].replace(".", "")) * 100 + (int(m[2]) if m[2].isdigit() else 0)


def words(text):
    return re.findall("[a-z0-9]+", text.lower().replace("ß", "ss"))


def extent(text):
    m = re.search(H.EXTENT, text)
    after = text[m.end() : m.end() + 90] if m else ""
    return m.start() if m and (re.search(H.BOOK_WORDS, after) or cents(after) is not None) else None


def asked(candidates):
    out = []
    for c in candidates:
        q = " ".join(re.sub(r"[\W_]+", " ", c).split()[:12])
        w = words(q)
        if len("".join(w)) >= 6 and (len(w) > 1 or len(w[0]) >= 8) and q not in out:
            out.append(q)
    return out[:6]


def hints(title, blocks):
    """(block, kind, reference, zone, lines, queries, cents) of an article's blocks in order."""
    refs = [list(dict.fromkeys(re.findall(H.REFERENCE, t))) for _, t in blocks]
    ext = [extent(t) for _, t in blocks]
    out, seen = [], set()
    for i, (block, text) in enumerate(blocks):
        for r in refs[i]:
            if r not in seen:
                seen.add(r)
                out.append((block, "number", r, None, None, None, None))
        if ext[i] is None:
            continue
        reach = next((j for j in range(i, min(len(blocks), i + 7)) if j > i and ext[j] is not None or refs[j]), None)
        if reach is not None and refs[reach] and (reach == i or ext[reach] is None):
            continue
        lead = text[: ext[i]].strip()
        below = blocks[i + 1][1] if i + 1 < len(blocks) else None
        price = cents(text[ext[i] :])
        if price is None and below is not None and len(below) <= 140:
            price = cents(below)
        citation = lead if 8 <= len(lead) <= 220 else ""
        description, top = "" if citation else text, i - 1
        if len(lead) < 8 and top >= 0 and len(blocks[top][1]) > 140 and ext[top] is None and not refs[top]:
            description, top = blocks[top][1], top - 1
        lines = []
        while top >= 0 and len(lines) < 5:
            line = blocks[top][1].strip()
            if not line or len(line) > 140 or ext[top] is not None or refs[top]:
                break
            lines.insert(0, line)
            top -= 1
        if (top < 0 and lines or not citation and not lines) and title and len(lines) < 5 and all(words(x) != words(title) for x in lines):
            lines.append(title)
        m = re.match(r"(.{4,160}?)\s+[–—]\s", description)
        opening = m[1] if m else ""
        parts = [p for p in (re.sub(r"[.:]+$", "", s).strip() for s in re.split(r"(?<=[.!?:])\s+|\s+[–—]\s+", citation)) if p]
        m = re.match(r"[^.!?]*[.!?]\s+([^:]+)", citation)
        queries = asked([" ".join(lines), *lines[::-1], m[1] if m else "", *parts[1:], parts[0] if parts else ""])
        out.append((block, "title", None, " ".join([*lines, citation or opening]).strip(), [*lines, *parts], queries, price))
    return out


def told(rows):
    return sorted(map(str, rows))


def test_hints_are_those_of_loops(spark):
    articles = defaultdict(list)
    for r in article_blocks(spark, SF).orderBy("block").collect():
        articles[r.article, r.title].append((r.block, r.text))
    expected = [(a, *h) for (a, title), blocks in articles.items() for h in hints(title, blocks)]
    found = H.find_hints(article_blocks(spark, SF), "article", "title", "block", "text").collect()
    assert told(tuple(r) for r in found) == told((a, b, k, r, z, x, q, c) for a, b, k, r, z, x, q, c in expected)
    assert {e[2] for e in expected} == {"number", "title"} and any(e[7] for e in expected)
    assert plans.queries()["printed_hints"](spark, SF).count() == len(expected)


@pytest.mark.parametrize(
    ("blocks", "title"),
    [
        (["Sophie Muster", "Im Kern – Ein Buch. " + "Text " * 40, "216 S., geb.", "t 18,–"], "Halbes Licht"),
        (["Alfred Beispiel. Das Werk – April 1945: Chronik. 368 S., geb., € 29,80"], "Besprechung"),
        (["Zeile", "120 S., Pb", "x", "y", "Art.-Nr. 101208"], "T"),
        (["120 S., Pb", "64 S., geb.", "Art. 101208 und Bestell-Nr.: 99999", "Art. 101208"], ""),
        (["a", "b", "c", "d", "e", "f", "200 Seiten, Leinen"], "Titel"),
        (["nur Text", "Art 120000 Mann"], "T"),
    ],
)
def test_forms_of_hints(spark, blocks, title):
    rows = [(1, title, k, t) for k, t in enumerate(blocks)]
    found = H.find_hints(spark.createDataFrame(rows, "a long, title string, k int, t string"), "a", "title", "k", "t").collect()
    assert told(tuple(r)[1:] for r in found) == told(hints(title, list(enumerate(blocks))))


@pytest.mark.parametrize(
    ("name", "makers", "price", "zone", "lines", "asked", "points"),
    [
        ("Der große Atlas", "Max Muster", 1990, "Max Muster Der große Atlas", ["Max Muster", "Der große Atlas"], 1990, 6),
        ("Der große Atlas", "Max Muster", 1990, "Der große Atlas", ["Der große", "Atlas"], 1500, 1),
        ("Atlas", "", None, "Ein Atlas", [], 5, -1),
        ("Atlas", "X", 5, "Ein Buch", [], 5, None),
        ("Unbekannt - April 1945, Band 1", "A. Meier/B. Kurz", 5, "Meier Unbekannt April 1945: Chronik. Bd. I: Anfang", ["x"], None, 1),
        ("Unbekannt - April 1945, Band 2", "Meier", 5, "Meier Unbekannt April 1945: Chronik. Bd. I: Anfang", ["x"], None, None),
    ],
)
def test_points_of_a_product(spark, name, makers, price, zone, lines, asked, points):
    df = spark.createDataFrame([(name, makers, price, zone, lines, asked)], "name string, makers string, price long, zone string, lines array<string>, asked long")
    assert df.select(L.title_points(*[F.col(c) for c in df.columns])).first()[0] == points
    if points is not None:
        assert df.select(F.array_contains(L.runs(F.col("zone")), L.first_words(F.col("name")))).first()[0]


@pytest.mark.parametrize(("words_", "run", "at"), [(["a", "b", "c"], ["b", "c"], 1), (["ab", "b"], ["b"], 1), (["a"], ["a", "b"], -1), (["a"], [], -1), ([], ["a"], -1)])
def test_place_of_a_run(spark, words_, run, at):
    df = spark.createDataFrame([(words_, run)], "w array<string>, r array<string>")
    assert df.select(L.run_at(df["w"], df["r"])).first()[0] == at


def test_copies_are_compared_once_and_counted(spark, tmp_path):
    rows = [("h", 5, 2, 7), ("h", 5, 1, 3), ("h", 4, 9, 0), ("g", 3, 1, 4)]
    best = R.best_of_counted(spark.createDataFrame(rows, "hint string, points int, n long, id long"), ["hint"], "id", "points", "n")
    assert sorted((r.hint, r.points, r.n, r.id) for r in best.collect()) == [("g", 3, 1, 4), ("h", 5, 3, 3)]
    part = spark.read.parquet(f"{SF}/part.parquet")
    copies = part.withColumn("p_partkey", F.explode(F.array(*[F.col("p_partkey") + k * 1000 for k in range(4)])))
    copies.write.parquet(f"{tmp_path}/part.parquet")
    sql = plans.oracle_sql()["hinted_products"].replace("FROM part", f"FROM '{tmp_path}/part.parquet/*.parquet'")
    found = plans.queries()["hinted_products"](spark, str(tmp_path))
    expected = duckdb.sql(sql)
    assert sorted(map(str, (tuple(r[c] for c in expected.columns) for r in found.collect()))) == sorted(map(str, expected.fetchall()))


def test_prices_are_weighed_apart_from_names(spark, tmp_path):
    """Few names with many prices, some unknown: the result is that of all pairs, while names meet texts without their prices."""
    key, rows = F.col("p_partkey"), spark.read.parquet(f"{SF}/part.parquet")
    few = rows.withColumns({"p_name": F.when(key % 5 > 0, F.lit("large ring")).otherwise(F.col("p_name")), "p_type": F.when(key % 3 > 0, F.lit("SMALL")).otherwise(F.col("p_type")), "p_size": (key % 4).cast("int")})
    few = few.withColumn("p_retailprice", F.when(key % 11 == 0, F.lit(None)).otherwise(F.lit(900.0) + key % 37))
    few.write.parquet(f"{tmp_path}/part.parquet")
    found = plans.queries()["hinted_products"](spark, str(tmp_path))
    hints, products = _hints_and_products(spark, str(tmp_path))
    pairs = hints.crossJoin(products).select("hint", "id", L.title_points(*[F.col(c) for c in ("name", "makers", "price", "zone", "lines", "asked")]).alias("points"))
    best = defaultdict(list)
    for r in pairs.filter("points >= 3").collect():
        best[r.hint].append((r.points, r.id))
    wanted = []
    for hint, own in best.items():
        top = [i for p, i in own if p == max(own)[0]]
        wanted.append((hint, max(own)[0], top[0] if len(top) == 1 else None))
    assert told(tuple(r) for r in found.collect()) == told(wanted) and {p for _, p, _ in wanted} >= {4, 6}
    makers = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "makers#" in line and "\\([^)]*\\)" in line]
    assert makers and not any("price#" in line for line in makers)


def test_long_articles_take_bounded_windows(spark):
    texts = ["120 S., Pb", "Zeile", "x" * 141, "Art.-Nr. 101208", "64 S., geb.", "", "Äußere Zeile – lang", "Art and Best of S. and Seiten"]
    blocks = [(k, texts[k * k * 7 % 11 % 8]) for k in range(400)]
    rows = spark.createDataFrame([(1, "Titel", k, t) for k, t in blocks], "a long, title string, k int, t string")
    found = H.find_hints(rows, "a", "title", "k", "t")
    assert told(tuple(r)[1:] for r in found.collect()) == told(hints("Titel", blocks))
    # what looks at all that follows takes as many steps for every block of an article
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()
