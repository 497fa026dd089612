"""Every query with SQL beside it gives the SQL's rows; the others are held against plain versions."""

import datetime
import math
import re
from collections import defaultdict, deque

import duckdb
import pytest

from quirelight import plans
from quirelight.functions import text as T
from quirelight.operators import relational as R
from quirelight.plans import layouts, timelines
from quirelight.plans.registry import read

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck():
    found = duckdb.connect()
    for name in TABLES:
        found.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return found


def told(value):
    return f"{value:.6f}" if isinstance(value, float) and not math.isnan(value) else str(value)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    expected = duck.sql(plans.oracle_sql()[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert {c: KINDS[k] for c, k in df.dtypes} == dict(zip(expected.columns, map(str, expected.types), strict=True))
    columns = df.columns
    ours = sorted(tuple(told(r[c]) for c in columns) for r in df.collect())
    assert ours
    assert ours == sorted(tuple(told(r[expected.columns.index(c)]) for c in columns) for r in expected.fetchall())


def test_limiter_is_exact(spark):
    rows = sorted((r.user_id, r.at, r.event_id) for r in timelines.events(spark, SF).collect())
    accepted, times = {}, defaultdict(deque)
    for user, at, event in rows:
        while times[user] and at - times[user][0] > 6 * 3600 * 1_000_000:
            times[user].popleft()
        accepted[event] = len(times[user]) < 3
        if accepted[event]:
            times[user].append(at)
    assert {r.event_id: r.accepted for r in timelines.accepted_requests(spark, SF).collect()} == accepted
    assert set(accepted.values()) == {True, False}


def test_merged_boxes(spark):
    expected = []
    for page, boxes in _by_page(layouts.boxes(spark, SF).collect()).items():
        left = sorted(boxes)
        while left:
            _, *box = left.pop(0)
            n = 1
            while near := next((b for b in left if b[1] <= box[2] + 0.012 and b[3] >= box[0] - 0.012 and b[2] <= box[3] + 0.012 and b[4] >= box[1] - 0.012), None):
                left.remove(near)
                box, n = [min(box[0], near[1]), min(box[1], near[2]), max(box[2], near[3]), max(box[3], near[4])], n + 1
            expected.append((page, *box, n))
    assert sorted(tuple(r) for r in layouts.merged_boxes(spark, SF).collect()) == sorted(expected)


def _by_page(rows):
    pages = defaultdict(list)
    for r in rows:
        pages[r.page].append((r.id, r.x0, r.y0, r.x1, r.y1))
    return pages


def test_chunks_cover_the_text(spark):
    """Pieces stand in the text one after another, none is too long, and only spaces lie between two."""
    pieces, several = defaultdict(list), 0
    for r in plans.queries()["text_chunks"](spark, SF).orderBy("doc_id", "at").collect():
        pieces[r.doc_id].append(r.piece)
    for r in read(spark, SF, "documents").collect():
        flat = re.sub(r"[ \t\n\x0b\f\r]+", " ", r.text or "").strip(" ")
        covered = 0
        for k, piece in enumerate(pieces[r.doc_id]):
            assert 0 < len(piece) <= 1200
            # the next piece starts within the overlap before the end of what is covered
            starts = [s for s in range(max(0, covered - 120), covered + 2) if flat.startswith(piece, s)]
            assert starts, (r.doc_id, k)
            assert starts[-1] == 0 or flat[starts[-1] - 1] == " " or starts[-1] == covered
            covered = starts[-1] + len(piece)
            assert covered == len(flat) or flat[covered] == " " or len(piece) == 1200
        assert covered >= len(flat)
        several += len(pieces[r.doc_id]) > 2
    assert several


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lit(value):
    from pyspark.sql import functions as F

    return F.lit(value)


@pytest.mark.parametrize(
    ("name", "title", "rank"),
    [
        ("The Old Harbour", "the old harbour", 3),
        ("The Old Harbour. A History", "The Old Harbour", 2),
        ("Ships and Storms at Sea", "Storms: Ships", 0),
        ("Harbour Storms of the North", "North Harbour Storms", 1),
        ("Lamp", "Ship", 0),
        ("", "Ship", 0),
    ],
)
def test_title_rank(spark, name, title, rank):
    assert one(spark, T.title_rank(lit(name), lit(title))) == rank


def test_scalars(spark):
    assert one(spark, T.main_title(lit("Harbours: A Short History"))) == "Harbours"
    assert one(spark, T.main_title(lit("Der: Eine kurze Geschichte"))) == "Der: Eine kurze Geschichte"  # no carrying word in front
    assert one(spark, T.clean_print_text(lit("ein Wort-\nteil und zwei\nZeilen\n\nAbsatz"))) == "ein Wortteil und zwei Zeilen\n\nAbsatz"
    assert one(spark, T.price_cents(lit("Preis 1.234,50 € frei Haus"))) == 123450
    assert one(spark, T.price_cents(lit("nur € 12,– heute"))) == 1200
    assert one(spark, T.price_cents(lit("kein Preis"))) is None
    assert one(spark, T.euro_display(lit(1234550))) == "12.345,50 €"
    assert one(spark, T.looks_doubled(lit("TTiitteell"))) is True
    assert one(spark, T.looks_doubled(lit("Titel Titel"))) is False
    assert one(spark, T.slug(lit("Über Größe & Maß"))) == "ueber-groesse-mass"
    assert one(spark, T.normal_email(lit("  A@B.org "))) == "a@b.org"
    assert one(spark, T.is_probable_heading(lit("Neue Wege"))) is True
    assert one(spark, T.strip_html(lit("<p>a&amp;b</p> <b>c</b>"))) == "a&b c"


def test_months_run_over(spark):
    from pyspark.sql import functions as F

    from quirelight.operators.relational import months_later

    assert one(spark, months_later(F.lit("2025-01-31").cast("date"), F.lit(1))) == datetime.date(2025, 3, 3)


def test_entry_smoke(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns
    assert set(plans.oracle_sql()) <= set(__spark_entry__.queries())


def test_equal_sets_of_one_parity_and_all_events(spark):
    rows = [(2, 7), (2, 8), (2, 7), (4, 8), (4, 7), (5, 8), (5, 7), (7, 8), (9, 8), (11, 9)]
    found = R.set_classes(spark.createDataFrame(rows, "k long, part long"), "k", "part").collect()
    assert sorted(map(tuple, found)) == [(2, 2, 3), (4, 2, 3), (5, 2, 3), (7, 7, 2), (9, 7, 2), (11, 11, 1)]
    queries = plans.queries()
    assert queries["part_set_classes"](spark, SF).count() == read(spark, SF, "lineitem").select("l_orderkey").distinct().count()
    assert queries["all_event_properties"](spark, SF).count() == read(spark, SF, "events").count() > queries["event_properties"](spark, SF).count()


def test_whole_text_of_stripped_pages(spark):
    whole = {r.page_id: r for r in plans.queries()["stripped_page_texts"](spark, SF).collect()}
    heads = plans.queries()["stripped_pages"](spark, SF).collect()
    assert len(heads) == len(whole) and any(len(whole[r.page_id].text) > 80 for r in heads)
    assert all(whole[r.page_id].text[:80] == r.head and len(whole[r.page_id].text) == r.n_chars for r in heads)
