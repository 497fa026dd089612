"""How surely a product is the one that a printed hint means, as column expressions over words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirelight.functions.text import bound, plain_tokens

# Words before the number of a volume, and Roman numbers up to twelve.
VOLUME_WORDS = ("band", "bd", "teil")
ROMAN = dict(zip("i ii iii iv v vi vii viii ix x xi xii".split(), map(str, range(1, 13)), strict=True))


def run_at(words: Column, run: Column) -> Column:
    """Where a run of words begins among others, from 0; -1 where it is empty or not there."""
    spaced = lambda a: F.concat(F.lit(" "), F.array_join(a, " "), F.lit(" "))
    before = F.split_part(spaced(words), spaced(run), F.lit(1))
    there = (F.size(run) > 0) & F.contains(spaced(words), spaced(run))
    return F.when(there, F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit("")))).otherwise(-1)


def surnames(makers: Column) -> Column:
    """The last word of each name in a field of makers, without what is in brackets and without short ones."""
    names = F.split(F.regexp_replace(makers, r"\([^)]*\)", " "), r"[/,;&]|\s+und\s+")
    last = F.transform(names, lambda n: F.coalesce(F.try_element_at(plain_tokens(n), F.lit(-1)), F.lit("")))
    return F.filter(last, lambda w: F.length(w) >= 3)


def volume_number(word: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in ROMAN.items() for x in pair])
    return F.coalesce(F.try_element_at(table, word), word)


def has_volume(name: Column) -> Column:
    """Whether a name of at least three words ends with a volume and its number."""
    return (F.size(name) >= 3) & F.coalesce(F.try_element_at(name, F.lit(-2)), F.lit("")).isin(*VOLUME_WORDS)


def name_in_zone(name: Column, zone: Column) -> Column:
    """The words of a name as they stand in a zone: all in one run, or without its volume where the zone names the same one elsewhere; else null."""

    def find(s: Column) -> Column:
        n, z = s["n"], s["z"]
        base = F.slice(n, 1, F.greatest(F.lit(1), F.size(n) - 2))
        number = volume_number(F.try_element_at(n, F.lit(-1)))
        named = F.exists(F.arrays_zip(z.alias("a"), F.concat(F.slice(z, 2, F.greatest(F.lit(0), F.size(z))), F.array(F.lit(""))).alias("b")), lambda p: p["a"].isin(*VOLUME_WORDS) & (volume_number(p["b"]) == number))
        return F.when(run_at(z, n) >= 0, n).when(has_volume(n) & named & (run_at(z, base) >= 0), base)

    return bound(F.struct(name.alias("n"), zone.alias("z")), find)


def title_points(name: Column, makers: Column, price: Column, zone: Column, lines: Column, asked: Column) -> Column:
    """Points of a product for a hint, null where its name does not stand in the zone.

    Equal prices give two, unequal known ones take one; all makers' surnames in the zone give two; a name that is one line, or two that follow each other, gives one;
    three words or more give one, a single word takes one.
    """
    facts = F.struct(name_in_zone(plain_tokens(name), plain_tokens(zone)).alias("n"), surnames(makers).alias("who"), plain_tokens(zone).alias("z"), F.transform(lines, lambda x: F.array_join(plain_tokens(x), " ")).alias("l"), price.alias("p"), asked.alias("q"))

    def count(s: Column) -> Column:
        one = lambda test, points: F.when(test, points).otherwise(0)
        key = F.array_join(s["n"], " ")
        two = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(s["l"]) - 2)), lambda i: F.concat_ws(" ", F.get(s["l"], i), F.get(s["l"], i + 1)))
        exact = F.array_contains(s["l"], key) | ((F.size(s["l"]) >= 2) & F.array_contains(two, key))
        prices = F.when(s["p"].isNotNull() & s["q"].isNotNull(), F.when(s["p"] == s["q"], 2).otherwise(-1)).otherwise(0)
        authors = (F.size(s["who"]) > 0) & F.forall(s["who"], lambda w: F.array_contains(s["z"], w))
        return F.when(s["n"].isNotNull(), prices + one(authors, 2) + one(exact, 1) + one(F.size(s["n"]) >= 3, 1) - one(F.size(s["n"]) == 1, 1))

    return bound(facts, count)


def first_words(name: Column, most: int = 3) -> Column:
    """The words that a name has to begin with in any zone where it stands, joined: what candidates are looked up by."""
    return bound(plain_tokens(name), lambda n: F.array_join(F.slice(n, 1, F.least(F.lit(most), F.when(has_volume(n), F.size(n) - 2).otherwise(F.size(n)))), " "))


def runs(zone: Column, most: int = 3) -> Column:
    """All runs of one to `most` words of a zone, joined, each once."""

    def of(z: Column) -> Column:
        return F.flatten(F.array(*[F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(z))), lambda i: i + k - 1 <= F.size(z)), lambda i: F.array_join(F.slice(z, i, k), " ")) for k in range(1, most + 1)]))

    return F.array_distinct(bound(plain_tokens(zone), of))
