"""Pictures and areas of pages against loops, and tables with spans by hand."""

from collections import defaultdict

from quirelight import plans
from quirelight.operators import geometry as G
from quirelight.operators import grids
from quirelight.plans import assembly

SF = "/root/testdata/sf0.001"


def size(b):
    return max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1])


def both(a, b):
    return (max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3]))


def density(b, words):
    return sum(size(both(b, w)) for w in words) / size(b) if size(b) > 0 else 0.0


def spread(b, words):
    cells = set()
    for w in words:
        s = both(b, w)
        if s[2] > s[0] and s[3] > s[1]:
            at = lambda v, lo, hi: min(3, int((v - lo) / (hi - lo) * 4))
            cells |= {(x, y) for x in range(at(s[0], b[0], b[2]), at(s[2], b[0], b[2]) + 1) for y in range(at(s[1], b[1], b[3]), at(s[3], b[1], b[3]) + 1)}
    return len(cells) / 16


def joined(boxes, words):
    boxes = [(b, 1) for b in boxes]
    again = True
    while again:
        again = False
        for i in range(len(boxes)):
            for j in range(i + 1, len(boxes)):
                (a, n), (b, m) = boxes[i], boxes[j]
                lap = size(both(a, b))
                whole = (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))
                if lap > 0 and lap >= 0.45 * min(size(a), size(b)) and size(whole) <= 1.8 * (size(a) + size(b) - lap) and density(whole, words) <= 0.07:
                    boxes[i] = (whole, n + m)
                    del boxes[j]
                    again = True
                    break
            if again:
                break
    return boxes


def test_picture_regions_are_those_of_loops(spark):
    pictures, words = assembly._pictures_and_words(spark, SF)
    by_page, all_words, body = defaultdict(list), defaultdict(list), defaultdict(list)
    for r in pictures.orderBy("id").collect():
        by_page[r.page].append(r)
    for w in words.collect():
        box = (w.x0, w.y0, w.x1, w.y1)
        all_words[w.page].append(box)
        if w.body:
            body[w.page].append(box)
    expected, trim = [], (0.02, 0.02, 0.98, 0.98)
    for page, own in by_page.items():
        held = []
        for r in own:
            b = both((r.x0, r.y0, r.x1, r.y1), trim)
            wide, high = b[2] - b[0], b[3] - b[1]
            if r.stencil or wide <= 0 or high <= 0 or size(b) < 0.010 or min(wide, high) < 0.055 or max(wide, high) / min(wide, high) > 5.5 or r.pixels and r.pixels < 90:
                continue
            if size(b) / size(trim) > 0.58 and density(b, all_words[page]) > 0.02:
                continue
            if size(b) >= 0.03 and density(b, body[page]) > 0.07 and spread(b, body[page]) > 0.45:
                continue
            held.append(b)
        for b, n in joined(held, body[page]):
            if size(b) >= 0.010 and min(b[2] - b[0], b[3] - b[1]) >= 0.055 and not (size(b) / size(trim) > 0.58 and density(b, all_words[page]) > 0.02):
                expected.append((page, *(round(x, 5) for x in b), n))
    found = plans.queries()["picture_regions"](spark, SF).collect()
    assert sorted((r.page, *(round(r[c], 5) for c in G.BOX), r.n) for r in found) == sorted(expected)
    assert any(e[-1] > 1 for e in expected) and len(expected) > 5


def test_reader_regions(spark):
    rows = [(1, 1, 1, 0.5, 0.1, 0.2, 1.4, None), (1, 1, 2, 0.5, 0.2, 0.6, 0.3, None), (1, 1, 3, 0.8, 0.8, 0.801, 0.9, None), (1, 1, 4, 0.0, 0.0, 0.1, 0.1, 7), (1, 1, 5, 0.05, 0.05, 0.1, 0.1, 8), (2, 1, 6, -0.2, -0.1, 0.2, 0.2, None)]
    df = spark.createDataFrame(rows, "article long, page long, id long, x0 double, y0 double, x1 double, y1 double, target long")
    found = {(r.article, r.target, r.x0, r.y0, r.x1, r.y1, r.n) for r in G.reader_regions(df, "article", "page", "target", "id").collect()}
    assert found == {(1, None, 0.2, 0.1, 0.6, 1.0, 2), (1, 7, 0.0, 0.0, 0.1, 0.1, 1), (1, 8, 0.05, 0.05, 0.1, 0.1, 1), (2, None, 0.0, 0.0, 0.2, 0.2, 1)}
    assert all(r.x0 < r.x1 and r.y0 < r.y1 for r in plans.queries()["reader_regions"](spark, SF).collect())


def test_spans_hide_cells_down_and_across(spark):
    kind = "t int, row int, col int, row_span int, col_span int, text string, fill string, bold boolean, declared int"
    rows = [(1, 0, 0, 2, 1, "a", None, True, 0), (1, 0, 1, 1, 5, "b", None, True, 0), (1, 0, 2, 1, 1, "hidden", None, False, 0), (1, 1, 0, 3, 1, "hidden", None, False, 0), (1, 1, 1, None, 0, "c", None, False, 0), (1, 2, 0, 9, 9, "d", None, False, 0)]
    rows += [(2, r, 0, 1, 1, "x", "grey" if r == 0 else "white", False, 0) for r in range(3)] + [(3, 0, 0, 1, 1, "y", None, False, 9)]
    seen = grids.with_headers(grids.visible_cells(spark.createDataFrame(rows, kind), "t"), "t", "declared", "fill", "bold")
    assert {(r.t, r.row, r.col, r.row_span, r.col_span, r.text, r.header) for r in seen.collect()} == {
        (1, 0, 0, 2, 1, "a", True), (1, 0, 1, 1, 2, "b", True), (1, 1, 1, 1, 1, "c", False), (1, 2, 0, 1, 3, "d", False),
        (2, 0, 0, 1, 1, "x", True), (2, 1, 0, 1, 1, "x", False), (2, 2, 0, 1, 1, "x", False), (3, 0, 0, 1, 1, "y", True),
    }
