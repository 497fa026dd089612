"""The queries of this subpackage: each applies its operator to a whole table and derives the digest columns."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelight.llm import ball_kmeans, conversation_repair, decontam, html_extract, lattice_lm, minhash, pii, quality, secret_scan, sharding, simhash, spm, url_filter
from quirelight.llm.common import crc_fold, table


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secret_scan(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("id", "doc_id").drop("text_hash")


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    counts = [f"n_{k}" for k in pii.KINDS]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), proximity=True)
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "n_near_items",
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = quality.learn(docs, table(spark, sf_dir, "labels"), folds=5)
    rows = docs.select("doc_id", (crc_fold(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    scored = quality.with_scores(rows, machine).drop("text")
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract_main_text(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return spm.sentencepiece_round_trip(docs, piece_model(), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op8_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.lattice_scores(table(spark, sf_dir, "documents"), piece_model()).withColumnRenamed("id", "doc_id")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=24)
    return placed.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.neighbour_likeness(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = ball_kmeans.compressed(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)
    digest = hashlib.sha256(books.decimals().encode()).hexdigest() if books else ""
    found = ball_kmeans.with_label_errors(coded)
    return found.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    found = conversation_repair.reports(conversation_repair.repaired(conversation_repair.damaged(rows)))
    every = rows.select("conv_id").distinct()
    joined = every.join(found, every["conv_id"].eqNullSafe(found["id"]), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    nothing = hashlib.sha256(b"").hexdigest()
    return joined.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


#: The contract's rules: verdict, host, path.
URL_RULES = (
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
)


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.verdicts(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_personal_data": op2_personal_data,
        "op3_decontamination": op3_decontamination,
        "op4_simhash": op4_simhash,
        "op5_quality": op5_quality,
        "op6_html_extract": op6_html_extract,
        "op7_sentencepiece": op7_sentencepiece,
        "op8_lattice_scores": op8_lattice_scores,
        "op9_sharding": op9_sharding,
        "op10_minhash": op10_minhash,
        "op11_vector_codes": op11_vector_codes,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_url_filter": op13_url_filter,
    }


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Windows are looked up as strings, and proximity is judged over all positions.  Rows are told apart by rowid, as ids may repeat.
OP3_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS doc, doc_id, {_WORDS} AS w FROM documents),
b AS MATERIALIZED (SELECT row_number() OVER () AS row, item_id, {_WORDS} AS w FROM benchmark),
sizes AS (SELECT DISTINCT CAST(least(len(w), 10) AS BIGINT) AS size FROM b WHERE len(w) > 0),
bw AS (SELECT item_id, size, unnest(range(1, CAST(len(w) - size + 2 AS BIGINT))) AS start, w FROM (SELECT *, CAST(least(len(w), 10) AS BIGINT) AS size FROM b WHERE len(w) > 0)),
item_windows AS (SELECT DISTINCT item_id, size, array_to_string(w[start : start + size - 1], ' ') AS gram FROM bw),
dw AS (SELECT doc, size, unnest(range(1, CAST(len(w) - size + 2 AS BIGINT))) AS start, w FROM d, sizes WHERE len(w) >= size),
doc_windows AS (SELECT doc, size, start, array_to_string(w[start : start + size - 1], ' ') AS gram FROM dw),
found AS MATERIALIZED (SELECT doc, size, start, item_id FROM doc_windows JOIN item_windows USING (size, gram)),
hit AS (SELECT doc, count(DISTINCT pos) AS n_hit FROM (SELECT doc, unnest(range(start, start + size)) AS pos FROM found) GROUP BY doc),
which AS (SELECT doc, list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))) AS items FROM found GROUP BY doc),
bt AS (SELECT DISTINCT row, item_id, unnest(w) AS term FROM b),
dt AS MATERIALIZED (SELECT doc, term, pos FROM (SELECT doc, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM d) WHERE term IN (SELECT term FROM bt)),
df AS (SELECT term, count(*) AS df FROM dt GROUP BY term),
ranked AS (SELECT row, item_id, term, row_number() OVER (PARTITION BY row ORDER BY coalesce(df, 0), term) AS rank FROM bt LEFT JOIN df USING (term)),
rare AS (SELECT *, count(*) OVER (PARTITION BY row) AS need FROM ranked WHERE rank <= 3),
placed AS (SELECT doc, row, item_id, need, rank, pos FROM dt JOIN rare USING (term)),
close AS (SELECT a.doc, a.row, a.item_id, a.need, a.pos, count(DISTINCT b.rank) AS n FROM placed a JOIN placed b ON a.doc = b.doc AND a.row = b.row AND abs(a.pos - b.pos) <= 20 WHERE a.rank = 1 GROUP BY ALL),
near AS (SELECT doc, count(DISTINCT item_id) AS n_near_items FROM close WHERE n = need GROUP BY doc)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near_items, 0) AS n_near_items
FROM d LEFT JOIN hit USING (doc) LEFT JOIN which USING (doc) LEFT JOIN near USING (doc)
"""

#: crc32 byte by byte with its table.
_CRC_TABLE = """bits AS (SELECT i, 0 AS k, CAST(i AS BIGINT) AS v FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY i) AS crc FROM bits WHERE k = 8)"""


def _crc(text: str) -> str:
    return f"""xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))),
  lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295)"""


#: The groups one by one, largest first, each to the shard with the least load, the first of these.
OP9_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, CAST(octet_length(encode(coalesce(text, ''))) + 8 AS BIGINT) AS size, sha256(coalesce(text, '')) AS key FROM documents),
summed AS (SELECT doc_id, size, key, {_crc('text')} AS text_crc32 FROM d, crc_table),
groups AS MATERIALIZED (SELECT key, CAST(sum(size) AS BIGINT) AS bytes FROM d GROUP BY key),
queue AS MATERIALIZED (SELECT bytes, row_number() OVER (ORDER BY bytes DESC, key) AS n FROM groups),
laid AS (SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS bytes, 0 AS shard, list_transform(range(24), lambda x: CAST(0 AS BIGINT)) AS loads
  UNION ALL
  SELECT n, bytes, shard, list_transform(loads, lambda x, i: CASE WHEN i = shard + 1 THEN x + bytes ELSE x END)
  FROM (SELECT queue.n, queue.bytes, laid.loads, CAST(list_position(laid.loads, list_min(laid.loads)) - 1 AS INTEGER) AS shard FROM laid JOIN queue ON queue.n = laid.n + 1)),
taken AS (SELECT bytes, shard, row_number() OVER (PARTITION BY bytes ORDER BY shard) AS place FROM laid WHERE n > 0),
placed AS (SELECT key, shard FROM (SELECT key, bytes, row_number() OVER (PARTITION BY bytes ORDER BY key) AS place FROM groups) JOIN taken USING (bytes, place))
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY left(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 2), doc_id NULLS FIRST, text_crc32, size) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM summed JOIN placed USING (key)
"""


def _nearest(step: int) -> str:
    """Parts with their nearest entries among those of a step, and the distances."""
    return f"""a{step} AS MATERIALIZED (SELECT row, part, x, min(code) AS code FROM (SELECT row, p.part, p.x, struct_pack(d := CAST(list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), entry := entry) AS code
  FROM p JOIN c{step} c ON p.part = c.part) GROUP BY row, part, x)"""


def _moved(step: int) -> str:
    """Entries at the floor of the mean of their parts; unused ones stay."""
    return f"""n{step} AS (SELECT part, entry, list(CAST((s - (((s % n) + n) % n)) // n AS BIGINT) ORDER BY place) AS x FROM
  (SELECT part, code.entry AS entry, place, CAST(sum(x[place]) AS BIGINT) AS s, count(*) AS n FROM a{step}, range(1, (SELECT w + 1 FROM width)) r(place) GROUP BY ALL) GROUP BY part, entry),
c{step + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(n.x, c.x) AS x FROM c{step} c LEFT JOIN n{step} n USING (part, entry))"""


#: Every part against every entry, round by round.
OP11_SQL = f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
width AS (SELECT CAST(max(len(v)) // 16 AS BIGINT) AS w FROM k),
p AS MATERIALIZED (SELECT row, CAST(part AS BIGINT) AS part, v[part * w + 1 : part * w + w] AS x FROM k, width, range(16) r(part)),
c0 AS MATERIALIZED (SELECT p.part, CAST(rank - 1 AS BIGINT) AS entry, p.x FROM p JOIN (SELECT row, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS rank FROM k) USING (row) WHERE rank <= 64),
{_nearest(0)}, {_moved(0)}, {_nearest(1)}, {_moved(1)}, {_nearest(2)},
books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS digest FROM c2),
coded AS (SELECT row, string_agg(lpad(lower(hex(code.entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(code.d) AS BIGINT) AS error FROM a2 GROUP BY row)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256 FROM coded JOIN k USING (row), books
"""

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_PUT_IN = "struct_pack(s := CASE WHEN w.s = 2 THEN 3 ELSE 2 END, cost := w.cost + 3, audit := w.audit || 'I', told := w.told || chr(10) || CASE WHEN w.s = 2 THEN 'assistant:' ELSE 'user:' END)"
_WITH_PUT_IN = f"list_concat(ways, list_transform(ways, lambda w: {_PUT_IN}), list_transform(list_transform(ways, lambda w: {_PUT_IN}), lambda w: {_PUT_IN}))"

#: All ways side by side, row by row: of those that end in the same state, the cheapest with the least audit goes on.
OP12_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
lots AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS lot FROM conversations, crc_table),
hurt AS (SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role, CASE lot WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN lot = 3 THEN 2 ELSE 1 END)) FROM lots WHERE lot != 0),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS k FROM hurt),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) AS seen FROM placed),
rows AS MATERIALIZED (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(rtrim(text, {_SPACES}), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM numbered),
walk AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS k, [struct_pack(s := 0, cost := 0, audit := '', told := '')] AS ways FROM conversations
  UNION ALL
  SELECT conv_id, k, list_filter(list_transform(range(4), lambda j: list_sort(list_filter(ways, lambda w: w.s = j))[1]), lambda w: w IS NOT NULL) FROM
  (SELECT conv_id, k, list_concat(list_transform(ways, lambda w: struct_pack(s := w.s, cost := w.cost + 4, audit := w.audit || 'D', told := w.told)),
    list_transform(list_filter(ways, lambda w: NOT gone AND (i = 's' AND w.s = 0 OR i = 'u' AND w.s != 2 OR i = 'a' AND w.s = 2)), lambda w: struct_pack(s := CASE i WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, cost := w.cost + more, audit := w.audit || 'K', told := w.told || chr(10) || role || ':' || text)),
    list_transform(list_filter(ways, lambda w: NOT gone), lambda w: struct_pack(s := CASE WHEN w.s = 2 THEN 3 ELSE 2 END, cost := w.cost + 3 + more, audit := w.audit || 'R', told := w.told || chr(10) || CASE WHEN w.s = 2 THEN 'assistant:' ELSE 'user:' END || text))) AS ways
   FROM (SELECT walk.conv_id, rows.k, rows.role, rows.text, rows.i, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS more, {_WITH_PUT_IN} AS ways
         FROM walk JOIN rows ON walk.conv_id IS NOT DISTINCT FROM rows.conv_id AND rows.k = walk.k + 1))),
ended AS (SELECT conv_id, list_sort(list_transform(list_filter({_WITH_PUT_IN}, lambda w: w.s IN (0, 3)), lambda w: struct_pack(cost := w.cost, audit := w.audit, told := w.told)))[1] AS best FROM walk QUALIFY k = max(k) OVER (PARTITION BY conv_id)),
counts AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(best.cost AS BIGINT) AS cost, best.audit AS audit, sha256(substr(best.told, 2)) AS repaired_sha256 FROM ended e LEFT JOIN counts c ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": OP3_SQL, "op9_sharding": OP9_SQL, "op11_vector_codes": OP11_SQL, "op12_conversation_repair": OP12_SQL}
