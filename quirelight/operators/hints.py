"""Hints to products in the ordered blocks of articles, by looking ahead and back a few blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirelight.functions import scalars as S
from quirelight.functions import text as T
from quirelight.functions.text import bound

# Numbers of articles as they are printed, the extent of a book, and what follows it where a book is described.
REFERENCE = r"(?<![A-Za-zÄÖÜäöüß])(?:Art\.|Art(?:ikel)?\.?[\s-]*(?:[Nn]r\.?|[Nn]ummer)|Best(?:ell)?\.?[\s-]*(?:[Nn]r\.?|[Nn]ummer))\s*:?\s*(\d{5,6})(?!\d)"
EXTENT = r"(?<![\d.,])(\d{2,3}|\d\.\d{3})\s?(?:S\.|Seiten)\s?,"
BOOK_WORDS = r"\b(?:geb|Pb|brosch|kart|Abb|Fotos|Karten|Hardcover|Paperback|Softcover|Großformat|farbig|Leinen)|€|EUR"
REACH, LONGEST_LINE, MOST_LINES, LONGEST_CITATION, SHORTEST, AFTER, MOST_QUERIES = 6, 140, 5, 220, 8, 90, 6


def references(text: Column) -> Column:
    # plain words first: most texts hold none, and the pattern looks back at every place
    asked = F.contains(text, F.lit("Art")) | F.contains(text, F.lit("Best"))
    return F.when(asked, T.references(text, REFERENCE)).otherwise(F.array().cast("array<string>"))


def extent_at(text: Column) -> Column:
    """Where the extent of a described book stands in a text, from 0; null where none does."""
    said = F.when(F.contains(text, F.lit("S.")) | F.contains(text, F.lit("Seiten")), F.regexp_substr(text, F.lit(EXTENT)))

    def judge(s: Column) -> Column:
        at = F.instr(s["t"], s["e"]) - 1
        after = F.substring(s["t"], at + F.length(s["e"]) + 1, F.lit(AFTER))
        return F.when(F.regexp_like(after, F.lit(BOOK_WORDS)) | T.price_cents(after).isNotNull(), at)

    return bound(F.struct(text.alias("t"), said.alias("e")), judge)


def citation_parts(lead: Column) -> Column:
    """A citation cut at the ends of sentences, at colons and at dashes."""
    pieces = F.transform(F.split(lead, r"(?<=[.!?:])\s+|\s+[–—]\s+"), lambda p: F.trim(F.regexp_replace(p, r"[.:]+$", "")))
    return F.filter(pieces, lambda p: p != "")


def _search_query(text: Column) -> Column:
    return F.substring_index(T.search_words(text), " ", 12)


def unique_queries(candidates: Column) -> Column:
    """Those candidates, as queries, that are worth a search, each once, at most six."""
    asked = F.array_distinct(F.transform(F.array_distinct(candidates), _search_query))
    return F.slice(F.filter(asked, S.worth_searching), 1, MOST_QUERIES)


def find_hints(blocks: DataFrame, article: str, title: str, order: str, text: str) -> DataFrame:
    """(article, block, kind, reference, zone, lines, queries, cents) from blocks with the article's title on each.

    number: the first block of an article with a printed article number.  title: a block that describes a book by its extent, unless a number follows within
    six blocks and before the next description; its lines are the short ones above it, with what of the citation or the title belongs there.
    All windows are bounded: six blocks back and six ahead, as what stands further off decides nothing.
    """
    rows = blocks.select(F.col(article).alias("article"), F.col(title).alias("title"), F.col(order).alias("block"), F.col(text).alias("text"))
    along = Window.partitionBy("article").orderBy("block")
    rows = rows.withColumns({"refs": references(F.col("text")), "at": extent_at(F.col("text")), "k": F.row_number().over(along)})
    named = F.size("refs") > 0
    numbers = rows.filter(named).select("article", "block", F.explode("refs").alias("reference")).groupBy("article", "reference").agg(F.min("block").alias("block"))
    # what may stand as a line; long texts are not carried along
    line = F.when((F.trim("text") != "") & (F.length(F.trim("text")) <= LONGEST_LINE) & F.col("at").isNull() & ~named, F.trim("text"))
    described = F.when((F.length("text") > LONGEST_LINE) & F.col("at").isNull() & ~named, F.col("text"))
    rows = rows.withColumns({"line": F.struct(line.alias("said")), "described": described})
    rows = rows.withColumns(
        {
            "next_ref": F.first(F.when(named, F.col("k")), ignorenulls=True).over(along.rowsBetween(0, REACH)),
            "next_at": F.first(F.when(F.col("at").isNotNull(), F.col("k")), ignorenulls=True).over(along.rowsBetween(1, REACH)),
            "below": F.lead("text").over(along),
            "top": F.lag("described").over(along),
            "above": F.collect_list("line").over(along.rowsBetween(-MOST_LINES - 1, -1)),
        }
    )
    near = F.coalesce(F.col("next_ref") <= F.col("k") + REACH, F.lit(False))
    covered = near & ((F.col("next_ref") == F.col("k")) | F.coalesce(F.col("next_ref") < F.col("next_at"), F.lit(True)))
    told = rows.filter(F.col("at").isNotNull() & ~covered)
    told = told.withColumn("lead", F.trim(F.substring("text", F.lit(1), F.col("at"))))
    cites = F.length("lead").between(SHORTEST, LONGEST_CITATION)
    # an extent in a block of its own stands under the description
    apart = (F.length("lead") < SHORTEST) & F.col("top").isNotNull()
    told = told.withColumns(
        {
            "cents": F.coalesce(T.price_cents(F.substring("text", F.col("at") + 1, F.length("text"))), F.when(F.length("below") <= LONGEST_LINE, T.price_cents(F.col("below")))),
            "citation": F.when(cites, F.col("lead")).otherwise(""),
            "description": F.when(apart, F.col("top")).when(cites, "").otherwise(F.col("text")),
            "over": F.reverse(F.slice("above", 1, F.greatest(F.lit(0), F.size("above") - apart.cast("int")))),
            "left": F.col("k") - 1 - apart.cast("int"),
        }
    )

    # the first above that is no line ends them
    ends = F.array_position(F.transform("over", lambda b: b["said"].isNull()), F.lit(True))
    n = F.least(F.lit(MOST_LINES), F.when(ends > 0, ends - 1).otherwise(F.size("over"))).cast("int")
    told = told.withColumn("n", n).withColumn("lines", F.reverse(F.transform(F.slice("over", 1, F.col("n")), lambda b: b["said"])))
    name = F.trim("title")
    same = bound(T.plain_title(name), lambda plain: F.exists("lines", lambda x: T.plain_title(x) == plain))
    asks = ((F.col("n") == F.col("left")) & (F.col("n") > 0)) | ((F.col("citation") == "") & (F.col("n") == 0))
    adds = asks & (name != "") & (F.length(name) <= LONGEST_LINE) & ~F.endswith(name, F.lit("…")) & (F.col("n") < MOST_LINES) & ~same
    told = told.withColumn("lines", F.when(adds, F.array_append("lines", name)).otherwise(F.col("lines")))
    opening = F.regexp_extract("description", r"^(.{4,160}?)\s+[–—]\s", 1)
    main = F.regexp_extract("citation", r"^[^.!?]*[.!?]\s+([^:]+)", 1)
    told = told.withColumns({"parts": F.when(F.col("citation") != "", citation_parts(F.col("citation"))).otherwise(F.array().cast("array<string>")), "main": main})
    last = F.coalesce(F.get("parts", F.lit(0)), F.lit(""))
    candidates = F.concat(F.array(F.array_join("lines", " ")), F.reverse("lines"), F.array("main"), F.slice("parts", 2, F.greatest(F.lit(0), F.size("parts") - 1)), F.array(last))
    zone = F.trim(F.array_join(F.concat("lines", F.array(F.when(F.col("citation") != "", F.col("citation")).otherwise(opening))), " "))
    titles = told.select("article", "block", F.lit("title").alias("kind"), F.lit(None).cast("string").alias("reference"), zone.alias("zone"), F.concat("lines", "parts").alias("lines"), unique_queries(candidates).alias("queries"), "cents")
    return numbers.withColumn("kind", F.lit("number")).unionByName(titles, allowMissingColumns=True).select(*titles.columns)


def block_kinds(text: Column, chars: Column, size: Column, most: Column, font: Column, bold: Column, body: Column, body_font: Column) -> Column:
    """What a block is, by a table of rules in order; the first that holds tells.

    body is the size of most of the text, body_font its font; most is the largest type in the block, chars how many characters it has.
    """
    # body_font may be unknown; then no block has another one
    foreign = F.coalesce((body_font != "") & (body_font != font), F.lit(False))
    head = T.is_probable_heading(text)
    initial = (most >= body * 1.7) & (size <= body * 1.15) & ~bold & ~foreign
    credit = F.regexp_like(F.lower(F.trim(text)), F.lit(r"^(fotos?:|bild:|grafik:|abb\.:)"))
    rules = (
        ("caption", credit),
        ("caption", most <= body * 0.9),
        ("heading", bold & foreign & (size >= body * 1.08) & (chars <= 140) & head),
        ("quote", foreign & (most <= body * 1.12) & (chars < 200)),
        ("caption", foreign & (most <= body * 1.12) & (chars <= 400)),
        ("heading", ~initial & (most >= body * 1.45) & ((size >= body * 1.25) | bold | foreign) & head),
        ("subheading", ~initial & (most >= body * 1.12) & (chars <= 120) & head),
        ("lead", ~initial & (most >= body * 1.12) & (chars <= 260) & head),
    )
    return F.coalesce(*[F.when(test, kind) for kind, test in rules], F.lit("paragraph"))
