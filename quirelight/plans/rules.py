"""Predicates and scalars of addresses, titles, prices, dates and keys, on strings made from the test tables.

Each query's docstring ends with the survey rows that it covers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelight.functions import scalars as S
from quirelight.functions import text as T
from quirelight.plans.registry import query, read


def _pick(key: Column, *choices: Column | str) -> Column:
    """One of the choices in turn, by the key; strings are literals."""
    return F.element_at(F.array(*[F.lit(c) if isinstance(c, str) else c for c in choices]), (key % len(choices) + 1).cast("int"))


@query(
    r"""WITH a AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN chr(9) || ' ' || c_name || '@Shop.Example' || chr(10) WHEN 1 THEN 'a@b.c' WHEN 2 THEN replace(c_name, '#', '.') || '@mail.example.org'
      WHEN 3 THEN 'two words@x.example' WHEN 4 THEN repeat('x', 250) || '@y.example' END AS typed FROM customer)
    SELECT c_custkey, lower(trim(coalesce(typed, ''), ' ' || chr(9) || chr(10))) AS address,
      length(coalesce(trim(typed, ' ' || chr(9) || chr(10)), '')) BETWEEN 6 AND 254 AND regexp_full_match(lower(trim(coalesce(typed, ''), ' ' || chr(9) || chr(10))), '[^\s@<>()",;:\\\[\]]+@[^\s@<>()",;:\\\[\]]+\.[a-z]{2,}') AS plausible FROM a"""
)
def plausible_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses as typed, in their normal form, and whether a letter could reach them. FLT-10, TXT-41"""
    name = F.col("c_name")
    typed = _pick(F.col("c_custkey"), F.concat(F.lit("\t "), name, F.lit("@Shop.Example\n")), "a@b.c", F.concat(F.replace(name, F.lit("#"), F.lit(".")), F.lit("@mail.example.org")), "two words@x.example", "x" * 250 + "@y.example", F.lit(None).cast("string"))
    address = T.normal_email(typed)
    return read(spark, sf_dir, "customer").select("c_custkey", address.alias("address"), S.is_plausible_address(address).alias("plausible"))


@query("SELECT c_custkey, regexp_full_match(token, '[A-Za-z0-9_-]{40,64}') AS is_token FROM (SELECT c_custkey, left(md5(CAST(c_custkey AS VARCHAR)) || '_-' || md5(c_name) || CASE WHEN c_custkey % 7 = 0 THEN '=' ELSE '' END, CAST(30 + c_custkey % 38 AS BIGINT)) AS token FROM customer)")
def token_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings that have the shape of a login token. FLT-11"""
    key = F.col("c_custkey")
    whole = F.concat(F.md5(key.cast("string").cast("binary")), F.lit("_-"), F.md5(F.col("c_name").cast("binary")), F.when(key % 7 == 0, "=").otherwise(""))
    token = F.left(whole, (30 + key % 38).cast("int"))
    return read(spark, sf_dir, "customer").select(key, F.regexp_like(token, F.lit("^[A-Za-z0-9_-]{40,64}$")).alias("is_token"))


@query(
    r"""WITH t AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN '/read/' || p_partkey WHEN 1 THEN '//other.example/x' WHEN 2 THEN 'https://x.example' WHEN 3 THEN '/login?next=/a' WHEN 4 THEN ' /shelf ' WHEN 5 THEN '/a b'
      WHEN 6 THEN '/Claim' END AS asked FROM part)
    SELECT p_partkey, CASE WHEN asked IS NULL OR length(trim(asked)) NOT BETWEEN 1 AND 300 OR NOT starts_with(trim(asked), '/') OR starts_with(trim(asked), '//') OR regexp_matches(trim(asked), '[\\\s\x00-\x1f\x7f]')
      OR regexp_matches(lower(trim(asked)), '^/(login|anmelden|claim)(/|\?|#|$)') THEN '/start' ELSE trim(asked) END AS target FROM t"""
)
def safe_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where to go after a login: a path of this site, or its start. FLT-12"""
    key = F.col("p_partkey")
    asked = _pick(key, F.concat(F.lit("/read/"), key.cast("string")), "//other.example/x", "https://x.example", "/login?next=/a", " /shelf ", "/a b", "/Claim", F.lit(None).cast("string"))
    return read(spark, sf_dir, "part").select("p_partkey", S.safe_path(asked, "/start").alias("target"))


@query(r"SELECT page_id, coalesce(starts_with(lower(url), 'https://') AND regexp_extract(lower(url), '^https://(?:www\.)?([^/?#:]*)', 1) = 'tionble.example.org' AND NOT regexp_matches(lower(url), '^https://www\.www\.'), false) AS own FROM pages")
def own_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses on one site or its www form, by https. FLT-13"""
    return read(spark, sf_dir, "pages").select("page_id", S.is_url_of(F.col("url"), "tionble.example.org").alias("own"))


@query(
    r"""WITH l AS (SELECT doc_id, string_split(text, chr(10))[1] AS line FROM documents WHERE text IS NOT NULL), d AS (SELECT *, regexp_replace(line, '(.)', '\1\1', 'g') AS twice FROM l)
    SELECT doc_id, trim(line) != '' AND length(trim(line)) <= 140 AND NOT (length(trim(line)) > 60 AND right(trim(line), 1) IN ('.', ':', ';', ',')) AS heading,
      (len(b) >= 8 AND len(b) % 2 = 0 AND len(list_filter(range(1, len(b), 2), lambda i: b[i] != b[i + 1])) = 0) AS doubled, (len(c) >= 8 AND len(c) % 2 = 0 AND len(list_filter(range(1, len(c), 2), lambda i: c[i] != c[i + 1])) = 0) AS line_doubled
    FROM (SELECT *, regexp_extract_all(regexp_replace(twice, '\s', '', 'g'), '.') AS b, regexp_extract_all(regexp_replace(line, '\s', '', 'g'), '.') AS c FROM d)"""
)
def heading_and_doubled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines that may be headings, and print that came out twice. FLT-15, FLT-17"""
    docs = read(spark, sf_dir, "documents").filter("text IS NOT NULL")
    lines = docs.select("doc_id", F.split("text", "\n")[0].alias("line"))
    twice = F.regexp_replace("line", "(.)", "$1$1")
    return lines.select("doc_id", T.is_probable_heading(F.col("line")).alias("heading"), T.looks_doubled(twice).alias("doubled"), T.looks_doubled(F.col("line")).alias("line_doubled"))


@query(
    r"""WITH n AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'Ada Brown/Carl von Berg' WHEN 1 THEN 'Ada Brown (Hg.)' WHEN 2 THEN 'Ada' WHEN 3 THEN 'Ada 2 Brown' WHEN 4 THEN 'Ada brown' WHEN 5 THEN p_name ELSE 'Émile Ünal (Hrsg.), Ben Cole' END AS name FROM part),
    w AS (SELECT *, list_filter(regexp_split_to_array(trim(regexp_replace(name, '\((Hrsg?|Hg)\.\)', '', 'g'), ' /'), '[\s/]+'), lambda x: x != '') AS words, trim(regexp_replace(name, '\((Hrsg?|Hg)\.\)', '', 'g'), ' /') AS bare FROM n),
    f AS (SELECT *, list_filter(regexp_split_to_array(trim(regexp_replace(regexp_split_to_array(name, '[/,;&]| und ')[1], '\((Hrsg?|Hg)\.\)', '', 'g')), '\s+'), lambda x: regexp_matches(x, '^[A-ZÄÖÜ]') AND length(x) > 1) AS parts FROM w)
    SELECT p_partkey, bare != '' AND length(bare) <= 90 AND NOT regexp_matches(bare, '[0-9]') AND len(words) BETWEEN 2 AND 9 AND len(list_filter(words, lambda x: NOT (regexp_matches(x, '^\p{Lu}') OR x IN ('v.', 'von', 'van', 'de', 'zu')))) = 0 AS is_name,
      regexp_replace(parts[-1], '\.$', '') AS surname FROM f"""
)
def author_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings that look like persons' names, and the surname of the first. FLT-25, TXT-12"""
    name = _pick(F.col("p_partkey"), "Ada Brown/Carl von Berg", "Ada Brown (Hg.)", "Ada", "Ada 2 Brown", "Ada brown", F.col("p_name"), "Émile Ünal (Hrsg.), Ben Cole")
    return read(spark, sf_dir, "part").select("p_partkey", S.looks_like_name(name).alias("is_name"), S.surname(name).alias("surname"))


@query(
    r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[^\p{L}\p{N}]+', ' ', 'g'))), lambda x: x != '') AS lines FROM documents),
    q AS (SELECT doc_id, list_transform(lines, lambda x: array_to_string(string_split(x, ' ')[1:12], ' ')) AS queries FROM l),
    k AS (SELECT doc_id, list_filter(queries, lambda x: length(regexp_replace(strip_accents(lower(x)).replace('ß', 'ss'), '[^a-z0-9]', '', 'g')) >= 6
      AND (len(regexp_extract_all(strip_accents(lower(x)).replace('ß', 'ss'), '[a-z0-9]+')) >= 2 OR length(regexp_replace(strip_accents(lower(x)).replace('ß', 'ss'), '[^a-z0-9]', '', 'g')) >= 8)) AS good FROM q)
    SELECT doc_id, coalesce(array_to_string(list_transform(list_sort(list_transform(list_distinct(good), lambda x: {'at': list_position(good, x), 'q': x}))[1:6], lambda x: x.q), '|'), '') AS queries FROM k WHERE good IS NOT NULL"""
)
def line_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to six different search queries from a document's lines, each specific enough. FLT-24, ORD-12, SET-04, TXT-05, TXT-13"""
    lines = F.filter(F.transform(F.split("text", "\n"), T.search_words), lambda x: x != "")
    queries = F.transform(lines, lambda x: F.array_join(F.slice(F.split(x, " "), 1, 12), " "))
    return read(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.array_join(F.slice(F.array_distinct(F.filter(queries, S.worth_searching)), 1, 6), "|").alias("queries"))


@query(
    """WITH RECURSIVE k AS MATERIALIZED (SELECT item_id, regexp_extract_all(text, '(?s).') AS c FROM benchmark),
    step AS (SELECT item_id, 0 AS n, CAST(2166136261 AS HUGEINT) AS h FROM k UNION ALL SELECT k.item_id, n + 1, (xor(CAST(h AS BIGINT), unicode(c[n + 1])) * CAST(16777619 AS HUGEINT)) % 4294967296 FROM step JOIN k ON k.item_id = step.item_id WHERE n < len(c))
    SELECT step.item_id, CAST(h AS BIGINT) AS fnv FROM step JOIN k ON k.item_id = step.item_id WHERE n = len(c)"""
)
def item_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """32-bit FNV-1a of each item. TXT-53"""
    return read(spark, sf_dir, "benchmark").select("item_id", S.fnv1a32(F.col("text")).alias("fnv"))


@query(
    """WITH RECURSIVE k AS MATERIALIZED (SELECT p_partkey, seed, array_to_string(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]+'), ' ') AS t FROM part, (VALUES (1), (2)) v(seed)),
    s AS (SELECT p_partkey, seed, 0 AS n, CAST(xor(3735928559, seed) AS HUGEINT) AS a, CAST(xor(1103547991, seed) AS HUGEINT) AS b FROM k
      UNION ALL SELECT k.p_partkey, k.seed, n + 1, (xor(CAST(a AS BIGINT), unicode(t[n + 1])) * CAST(2654435761 AS HUGEINT)) % 4294967296, (xor(CAST(b AS BIGINT), unicode(t[n + 1])) * CAST(1597334677 AS HUGEINT)) % 4294967296
      FROM s JOIN k ON k.p_partkey = s.p_partkey AND k.seed = s.seed WHERE n < length(t)),
    e AS (SELECT s.p_partkey, s.seed, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM s JOIN k ON k.p_partkey = s.p_partkey AND k.seed = s.seed WHERE n = length(t)),
    f AS (SELECT p_partkey, seed, b, xor(CAST((xor(a, a >> 16) * CAST(2246822507 AS HUGEINT)) % 4294967296 AS BIGINT), CAST((xor(b, b >> 13) * CAST(3266489909 AS HUGEINT)) % 4294967296 AS BIGINT)) AS a FROM e),
    g AS (SELECT p_partkey, seed, a, xor(CAST((xor(b, b >> 16) * CAST(2246822507 AS HUGEINT)) % 4294967296 AS BIGINT), CAST((xor(a, a >> 13) * CAST(3266489909 AS HUGEINT)) % 4294967296 AS BIGINT)) AS b FROM f)
    SELECT p_partkey, max(CASE WHEN seed = 1 THEN 4294967296 * (b & 2097151) + a END) AS first, max(CASE WHEN seed = 2 THEN 4294967296 * (b & 2097151) + a END) AS second FROM g GROUP BY p_partkey"""
)
def block_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two 53-bit hashes of a block's words, as which it is known again in the next issue. TXT-06"""
    words = F.array_join(T.plain_tokens(F.concat_ws(" ", "p_name", "p_type")), " ")
    return read(spark, sf_dir, "part").select("p_partkey", *[S.hash53(words, seed).alias(name) for seed, name in ((1, "first"), (2, "second"))])


@query()
def block_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same two hashes written in base 36, one after the other. TXT-07"""
    words = F.array_join(T.plain_tokens(F.concat_ws(" ", "p_name", "p_type")), " ")
    return read(spark, sf_dir, "part").select("p_partkey", S.block_key(words).alias("key"))


@query(
    """WITH a AS (SELECT p_partkey, n, (CAST(p_partkey AS HUGEINT) + n * CAST(1831565813 AS HUGEINT)) % 4294967296 AS a FROM part, range(1, 4) r(n)),
    t AS (SELECT p_partkey, n, CAST((CAST(xor(CAST(a AS BIGINT), CAST(a AS BIGINT) >> 15) AS HUGEINT) * (CAST(a AS BIGINT) | 1)) % 4294967296 AS BIGINT) AS t FROM a),
    u AS (SELECT p_partkey, n, xor(CAST((t + (CAST(xor(t, t >> 7) AS HUGEINT) * (t | 61)) % 4294967296) % 4294967296 AS BIGINT), t) AS t FROM t)
    SELECT p_partkey, CAST(n AS INTEGER) AS n, xor(t, t >> 14) AS draw FROM u"""
)
def seeded_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three numbers of each part's own random stream. TXT-54"""
    return read(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("n")).withColumn("draw", S.mulberry32(F.col("p_partkey"), F.col("n")))


@query()
def seeded_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places 0 to 15 in an order of each part's own, drawn from its random stream. TXT-55"""
    return read(spark, sf_dir, "part").select("p_partkey", S.shuffled(16, F.col("p_partkey")).alias("places"))


@query(
    """WITH t AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN ' ' || p_size || ',5 ' WHEN 1 THEN CAST(p_size AS VARCHAR) WHEN 2 THEN p_size || '.25' WHEN 3 THEN 'on request' WHEN 4 THEN '-' || p_size WHEN 5 THEN '100000.5' END AS typed FROM part)
    SELECT p_partkey, CASE WHEN n BETWEEN 0 AND 100000 THEN CAST(round(n * 100) AS BIGINT) END AS cents FROM (SELECT p_partkey, TRY_CAST(replace(trim(typed), ',', '.') AS DOUBLE) AS n FROM t)"""
)
def typed_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices as typed, in cents; none where they are no number from 0 to 100,000. TXT-36"""
    size = F.col("p_size").cast("string")
    typed = _pick(F.col("p_partkey"), F.concat(F.lit(" "), size, F.lit(",5 ")), size, F.concat(size, F.lit(".25")), "on request", F.concat(F.lit("-"), size), "100000.5", F.lit(None).cast("string"))
    return read(spark, sf_dir, "part").select("p_partkey", S.typed_cents(typed).alias("cents"))


@query(
    """WITH h AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '<span itemprop="price" data-x="1" content="' || p_size || '.5">' WHEN 1 THEN '<i ITEMPROP="price" content="' || p_size || ',99">' WHEN 2 THEN '<i itemprop="price" content="0">' ELSE '<i content="5">' END AS html FROM part)
    SELECT p_partkey, CAST(round(n * 100) AS BIGINT) AS cents FROM (SELECT p_partkey, CASE WHEN n > 0 THEN n END AS n FROM (SELECT p_partkey, TRY_CAST(replace(regexp_extract(html, '(?i)itemprop="price"[^>]*content="([0-9]+(?:[.,][0-9]{1,2})?)"', 1), ',', '.') AS DOUBLE) AS n FROM h))"""
)
def marked_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices that a page marks for machines, in cents. TXT-35"""
    size = F.col("p_size").cast("string")
    html = _pick(F.col("p_partkey"), F.concat(F.lit('<span itemprop="price" data-x="1" content="'), size, F.lit('.5">')), F.concat(F.lit('<i ITEMPROP="price" content="'), size, F.lit(',99">')), '<i itemprop="price" content="0">', '<i content="5">')
    return read(spark, sf_dir, "part").select("p_partkey", S.marked_cents(html).alias("cents"))


@query(
    r"""WITH t AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'Bestellung: nur 1.234,50 € frei Haus' WHEN 1 THEN 'EUR ' || p_size || ',–' WHEN 2 THEN p_size || ',95 Euro, Art. 10' || lpad(CAST(p_size AS VARCHAR), 3, '0') WHEN 3 THEN 'kostenlos'
      WHEN 4 THEN 'geb., t ' || p_size || ',80' WHEN 5 THEN 'statt 1234,50 € € ' || p_size || ',—' WHEN 6 THEN 'mit ' || p_size || ',50  € und ' || p_size || ',-EUR' ELSE p_size || ' €' END AS text FROM part),
    m AS (SELECT p_partkey, regexp_extract(text, '(?:€|EUR|(?:^|[^A-Za-zÄÖÜäöüß])t)\s?(\d{1,3}(?:\.\d{3})*),(\d{2}|[–—-])', ['e', 'c']) AS a, regexp_extract(text, '(\d{1,3}(?:\.\d{3})*),(\d{2}|[–—-])\s?(?:€|EUR)', ['e', 'c']) AS b FROM t),
    p AS (SELECT p_partkey, CASE WHEN a.e != '' THEN a ELSE b END AS p FROM m)
    SELECT p_partkey, CASE WHEN p.e != '' THEN CAST(replace(p.e, '.', '') AS BIGINT) * 100 + coalesce(TRY_CAST(p.c AS BIGINT), 0) END AS cents FROM p"""
)
def printed_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first price of a text in its printed form, in cents. TXT-18"""
    size = F.col("p_size").cast("string")
    article = F.concat(size, F.lit(",95 Euro, Art. 10"), F.lpad(size, 3, "0"))
    typeset = F.concat(F.lit("geb., t "), size, F.lit(",80"))
    two = F.concat(F.lit("statt 1234,50 € € "), size, F.lit(",—"))
    wide = F.concat(F.lit("mit "), size, F.lit(",50  € und "), size, F.lit(",-EUR"))
    text = _pick(F.col("p_partkey"), "Bestellung: nur 1.234,50 € frei Haus", F.concat(F.lit("EUR "), size, F.lit(",–")), article, "kostenlos", typeset, two, wide, F.concat(size, F.lit(" €")))
    return read(spark, sf_dir, "part").select("p_partkey", T.price_cents(text).alias("cents"))


@query(
    r"""WITH s AS (SELECT p_partkey, left(regexp_replace(regexp_replace(strip_accents(lower(p_brand || ' Größe É Žižek Čapek ' || p_name).replace('ä', 'ae').replace('ö', 'oe').replace('ü', 'ue').replace('ß', 'ss')), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 80) AS slug,
      left(regexp_replace(regexp_replace(upper('ü' || replace(p_brand, '#', '-') || p_type).replace('Ü', 'UE'), '[^A-Z0-9-]+', '', 'g'), '^-+|-+$', '', 'g'), 20) AS code, CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 100 || '/20' || p_size % 10 + 10 END AS number FROM part)
    SELECT p_partkey, slug, code, code || '-' || coalesce(nullif(regexp_replace(regexp_replace(upper(coalesce(number, '')), '[^A-Z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), right('00000' || p_partkey, 6)) || '-DIGITAL' AS sku FROM s"""
)
def shop_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs, codes of series and article numbers that are made of names; without a number, of the end of the id. TXT-38, TXT-39, TXT-40"""
    key = F.col("p_partkey")
    slug = S.long_slug(F.concat_ws(" ", "p_brand", F.lit("Größe É Žižek Čapek"), "p_name"))
    code = S.series_code(F.concat(F.lit("ü"), F.replace("p_brand", F.lit("#"), F.lit("-")), F.col("p_type")))
    number = F.when(key % 3 > 0, F.concat((key % 100).cast("string"), F.lit("/20"), (F.col("p_size") % 10 + 10).cast("string")))
    tail = F.right(F.concat(F.lit("00000"), key.cast("string")), F.lit(6))
    return read(spark, sf_dir, "part").select("p_partkey", slug.alias("slug"), code.alias("code"), S.digital_sku(code, number, tail).alias("sku"))


@query("SELECT o_orderkey, CASE WHEN n >= 1e9 THEN format('{:.1f} GB', n / 1e9) WHEN n >= 1e6 THEN CAST(round(n / 1e6) AS BIGINT) || ' MB' WHEN n >= 1e3 THEN CAST(round(n / 1e3) AS BIGINT) || ' kB' ELSE n || ' B' END AS shown FROM (SELECT o_orderkey, CAST(pow(3, o_orderkey % 21) AS BIGINT) AS n FROM orders)")
def shown_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of files as they are shown. TXT-59"""
    size = F.pow(F.lit(3), F.col("o_orderkey") % 21).cast("long")
    return read(spark, sf_dir, "orders").select("o_orderkey", S.shown_bytes(size).alias("shown"))


@query(
    r"""WITH m AS (SELECT ['Januar', 'Februar', 'März', 'April', 'Mai', 'Juni', 'Juli', 'August', 'September', 'Oktober', 'November', 'Dezember'] AS names),
    i AS (SELECT o_orderkey, o_orderkey % 2 = 0 AS numbered, CASE o_orderkey % 6 WHEN 0 THEN '17' WHEN 1 THEN month(o_orderdate) || '/' || year(o_orderdate) WHEN 2 THEN ' 23 b ' WHEN 3 THEN '3-4/1997' WHEN 4 THEN 'x' ELSE 'none' END AS number,
      CASE o_orderkey % 4 WHEN 0 THEN 'Heft 17 neu' WHEN 1 THEN 'Ausgabe ' || names[month(o_orderdate)] || ' ' || year(o_orderdate) WHEN 2 THEN 'NR. 23' ELSE 'April 1997' END AS label FROM orders, m),
    p AS (SELECT *, regexp_extract(trim(number), '^([0-9]+)', 1) AS n, regexp_extract(trim(number), '^([0-9]{1,2})(?:[-/]([0-9]{1,2}))?/([0-9]{4})$', ['a', 'b', 'y']) AS d FROM i)
    SELECT o_orderkey, CASE WHEN numbered THEN CASE WHEN n != '' THEN 'Series ' || n END WHEN d.a != '' AND names[TRY_CAST(d.a AS INTEGER)] IS NOT NULL THEN 'Series ' || names[TRY_CAST(d.a AS INTEGER)] || ' ' || d.y END AS query,
      CASE WHEN numbered THEN n != '' AND n = regexp_extract(label, '(?i)(?:Nr\.?|Heft)\s*([0-9]+)\b', 1)
        ELSE d.a != '' AND contains(label, d.y) AND (coalesce(contains(label, names[TRY_CAST(d.a AS INTEGER)]), false) OR coalesce(contains(label, names[TRY_CAST(d.b AS INTEGER)]), false)) END AS fits FROM p, m"""
)
def issue_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to search for an issue by its number, and whether a label of the shop means it. TXT-42, TXT-43"""
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    year = F.year(day).cast("string")
    number = _pick(key, "17", F.concat_ws("/", F.month(day).cast("string"), year), " 23 b ", "3-4/1997", "x", "none")
    label = _pick(key, "Heft 17 neu", F.concat_ws(" ", F.lit("Ausgabe"), S.month_name(F.month(day)), year), "NR. 23", "April 1997")
    rows = read(spark, sf_dir, "orders").select("o_orderkey", (key % 2 == 0).alias("numbered"), number.alias("number"), label.alias("label"))
    return rows.select("o_orderkey", S.issue_query(F.lit("Series"), F.col("numbered"), F.col("number")).alias("query"), S.label_fits(F.col("label"), F.col("numbered"), F.col("number")).alias("fits"))


@query(
    r"""WITH f AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name || ' ' || p_size || ', innenteil + titelseite' WHEN 1 THEN p_name || ' ' || (1 + p_size % 12) || '-2026 Innen' WHEN 2 THEN ' ' || p_name || ' 036 extra, umschlag' WHEN 3 THEN p_name ELSE p_size || '_cover' END AS folder FROM part),
    r AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(trim(folder), '(?i)[\s,+_-]*\b(innenteile?|innen|titelseiten?|titel|umschlag|cover)\b.*$', ''), '[\s,;+_-]+$', '')) AS rest, folder FROM f),
    m AS (SELECT *, regexp_extract(rest, '^(.*?)([0-9]{1,2})\s*[-/]\s*([0-9]{4})(.*)$', ['head', 'm', 'y', 'tail']) AS a, regexp_extract(rest, '^(.*?)([0-9]{1,4})(.*)$', ['head', 'n', 'tail']) AS b FROM r),
    s AS (SELECT p_partkey, rest, folder, CASE WHEN a.y != '' THEN TRY_CAST(a.m AS INTEGER) || '/' || a.y WHEN b.n != '' THEN CAST(TRY_CAST(b.n AS INTEGER) AS VARCHAR) END AS number, CASE WHEN a.y != '' THEN a.head WHEN b.n != '' THEN b.head ELSE rest END AS head, CASE WHEN a.y != '' THEN a.tail WHEN b.n != '' THEN b.tail ELSE '' END AS tail FROM m)
    SELECT p_partkey, number, coalesce(nullif(trim(regexp_replace(head, '[\s,;+_-]+$', '')), ''), nullif(rest, ''), folder) AS series, nullif(trim(regexp_replace(regexp_replace(tail, '^[\s,;+_-]+', ''), '[\s,;+_-]+$', '')), '') AS subtitle,
      coalesce(nullif(trim(regexp_replace(regexp_replace(tail, '^[\s,;+_-]+', ''), '[\s,;+_-]+$', '')), ''), concat_ws(' ', coalesce(nullif(trim(regexp_replace(head, '[\s,;+_-]+$', '')), ''), nullif(rest, ''), folder), number)) AS title FROM s"""
)
def folder_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series, number, subtitle and title that the name of a folder tells, in the case it has. SRC-27 (but for capitals), TXT-63"""
    size, name = F.col("p_size").cast("string"), F.col("p_name")
    month = (1 + F.col("p_size") % 12).cast("string")
    folder = _pick(F.col("p_partkey"), F.concat(name, F.lit(" "), size, F.lit(", innenteil + titelseite")), F.concat(name, F.lit(" "), month, F.lit("-2026 Innen")), F.concat(F.lit(" "), name, F.lit(" 036 extra, umschlag")), name, F.concat(size, F.lit("_cover")))
    return read(spark, sf_dir, "part").select("p_partkey", folder.alias("folder")).select("p_partkey", S.folder_parts(F.col("folder")).alias("f")).select("p_partkey", "f.number", "f.series", "f.subtitle", "f.title")


@query(
    """WITH known AS (SELECT DISTINCT regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, upper(p_name) AS name FROM part),
    now AS (SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) ELSE 'Our ' || p_name END AS name FROM part)
    SELECT p_partkey, CASE WHEN now.name != known.name AND regexp_replace(regexp_replace(lower(now.name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') = slug THEN known.name END AS renamed FROM now LEFT JOIN known USING (slug)"""
)
def canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept name of a series where the present one was only made of its slug. TXT-44"""
    part = read(spark, sf_dir, "part")
    known = part.select(T.slug(F.col("p_name")).alias("slug"), F.upper("p_name").alias("known")).distinct()
    present = _pick(F.col("p_partkey"), F.col("p_name"), F.upper("p_name"), F.concat(F.lit("Our "), F.col("p_name")))
    now = part.select("p_partkey", T.slug(F.col("p_name")).alias("slug"), present.alias("name")).join(known, "slug", "left")
    return now.select("p_partkey", F.when((F.col("name") != F.col("known")) & (T.slug(F.col("name")) == F.col("slug")), F.col("known")).alias("renamed"))


@query(
    r"""WITH i AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN month(o_orderdate) || ' / ' || year(o_orderdate) WHEN 1 THEN CAST(o_orderkey % 300 AS VARCHAR) END AS number, CASE o_orderkey % 3 WHEN 0 THEN 'Ausgabe März/April 1996' WHEN 1 THEN 'Juni' END AS edition,
      CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate END AS day_at FROM orders),
    p AS (SELECT *, regexp_extract(coalesce(number, ''), '^([0-9]{1,2})\s*/\s*((?:19|20)[0-9]{2})$', ['m', 'y']) AS s, nullif(regexp_extract(coalesce(number, '') || ' ' || coalesce(edition, ''), '\b((?:19|20)[0-9]{2})\b', 1), '') AS y FROM i)
    SELECT o_orderkey, CAST(coalesce(nullif(s.y, ''), p.y, CAST(year(day_at) AS VARCHAR)) AS INTEGER) AS year,
      CAST(100000 * coalesce(TRY_CAST(s.m AS INTEGER), CASE WHEN contains(edition, 'März') THEN 3 WHEN contains(edition, 'Juni') THEN 6 END, month(day_at), 0) + coalesce(TRY_CAST(CASE WHEN regexp_full_match(number, '[0-9]+') THEN number END AS INTEGER), 0) AS INTEGER) AS rank,
      CASE WHEN s.y != '' THEN epoch_ms(make_date(TRY_CAST(s.y AS INTEGER), TRY_CAST(s.m AS INTEGER), 1)) END AS published_ms, CAST(epoch(day_at) AS BIGINT) * 1000 AS at_ms FROM p"""
)
def issue_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year and rank in it of an issue, from its number, edition or date, and dates in milliseconds. AGG-09, DAT-03, DAT-07, DAT-08"""
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    number = _pick(key, F.concat_ws(" / ", F.month(day).cast("string"), F.year(day).cast("string")), (key % 300).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", number.alias("number"), _pick(key, "Ausgabe März/April 1996", "Juni", F.lit(None).cast("string")).alias("edition"), F.when(key % 5 > 0, day).alias("at"))
    slash = r"^(\d{1,2})\s*/\s*((?:19|20)\d{2})$"
    month, year = (S.found("number", slash, i).cast("int") for i in (1, 2))
    return rows.select(
        "o_orderkey",
        S.issue_year(F.col("number"), F.col("edition"), F.col("at")).alias("year"),
        S.issue_rank(F.col("number"), F.col("edition"), F.col("at")).alias("rank"),
        S.millis(F.unix_seconds(F.make_date(year, month, F.lit(1)).cast("timestamp"))).alias("published_ms"),
        S.millis(F.unix_seconds(F.col("at").cast("timestamp"))).alias("at_ms"),
    )


@query(
    r"""WITH l AS (SELECT item_id, (item_id % 90) || ' ' || upper(left(text, 1)) || ' ' || lower(text[2:]) AS line FROM benchmark)
    SELECT item_id, CASE WHEN regexp_matches(line, '^([0-9]{1,3}\s+)?[A-ZÄÖÜ]\s+[a-zäöüß]') THEN regexp_replace(line, '^([0-9]{1,3}\s+)?([A-ZÄÖÜ])\s+', '\2') ELSE line END AS glued,
      regexp_replace(strip_accents(lower(line)), '[^a-z0-9]+', '', 'g') AS compared FROM l"""
)
def dropcap_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their initial put back to its word, and the form in which they are compared. TXT-02, TXT-04"""
    line = F.concat((F.col("item_id") % 90).cast("string"), F.lit(" "), F.upper(F.left("text", F.lit(1))), F.lit(" "), F.lower(F.substring("text", F.lit(2), F.length("text"))))
    return read(spark, sf_dir, "benchmark").select("item_id", S.glue_initial(line).alias("glued"), S.comparable(line).alias("compared"))


@query(
    """WITH w AS (SELECT * FROM (VALUES ('view', 10), ('click', 25), ('signup', 5), ('purchase', 50), ('error', 10)) v(phase, weight))
    SELECT user_id, CAST(round(100.0 * sum(weight) / (SELECT sum(weight) FROM w WHERE phase != 'error')) AS INTEGER) AS percent FROM (SELECT DISTINCT user_id, event_type AS phase FROM events WHERE value >= 80) JOIN w USING (phase) WHERE phase != 'error' GROUP BY user_id"""
)
def weighted_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a run is, by the weights of the phases that are done; one phase is left out. AGG-49"""
    weights = {"view": 10, "click": 25, "signup": 5, "purchase": 50}
    weight = F.element_at(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]), F.col("event_type"))
    done = read(spark, sf_dir, "events").filter("value >= 80 AND event_type != 'error'").select("user_id", "event_type").distinct()
    return done.groupBy("user_id").agg(F.round(100 * F.sum(weight) / sum(weights.values())).cast("int").alias("percent"))
