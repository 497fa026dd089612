"""Secret scan with corpus-wide ownership frequency.

Every text is scanned once for candidates.  Hashes of the candidates are then counted over the whole
corpus by distinct repositories and owners: a value that many owners hold is a copied example, one
that stays with few owners and looks random is a live-looking credential of its owner.

Base kinds are assign, access and hex (see KINDS); the method adds jwt, pem and url spans.

Defined cases: null and empty texts have no spans; a null owner or repository counts as one owner or
repository of its own; repeated rows are counted as rows but not as further owners; ids may be null.
Texts are searched whole, however long; an empty table gives no rows; further columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelight.llm.common import cut_lineage

KINDS = ("assign", "access", "hex", "jwt", "pem", "url")
BASE_KINDS = KINDS[:3]

_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # as AKIA[A-Z0-9]+ of 18 or more: a run ends where it ends
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")  # as [0-9a-f]+ of 16 or more
_JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
_PEM = re.compile(r"-----(BEGIN|END) ([A-Z ]*PRIVATE KEY)-----")
# what follows a BEGIN line without END: headers, then key characters in long pieces and a last short one that is a line
# of its own or is padded; line ends may be written as \n or \r
_PEM_GAP = r"(?:\s|\\[nr])"
_PEM_BODY = re.compile(
    rf"(?:{_PEM_GAP}*+(?:Proc-Type|DEK-Info):[^\n\\]*+)*+(?:{_PEM_GAP}*+(?!-----)[A-Za-z0-9+/]{{16,}}+={{0,2}})*+"
    rf"(?:{_PEM_GAP}*+[A-Za-z0-9+/]++={{1,2}}|(?:[\x20\t\r]*+(?:\n|\\n|\\r))++[\x20\t]*+[A-Za-z0-9+/]++(?=[\x20\t]*+(?:[\r\n\"'`]|\\[nr]|-----|\Z)))?"
)
# neither part can hold the sign that ends it, so each text is read once
_URL = re.compile(r"://[A-Za-z0-9._~-]++:([^\s:/@]{6,}+)@")


def _keys(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of private keys, from the BEGIN line to the END line of the same name, or as far as key characters go."""
    lines = list(_PEM.finditer(text))
    for m, after in zip(lines, [*lines[1:], None], strict=True):
        if m[1] == "BEGIN":
            closed = after and after[1] == "END" and after[2] == m[2]
            yield m.start(), after.end() if closed else _PEM_BODY.match(text, m.end()).end()


def scan(text: str) -> list[tuple[int, int, str, str]]:
    """(start, rank of the kind, span "kind:start:end", value) in order."""
    found = []
    for m in _ASSIGN.finditer(text):
        if len(m[2]) >= 12:
            found.append((m.start(), 0, f"assign:{m.start()}:{m.end()}", m[2]))
    for m in _ACCESS.finditer(text):
        found.append((m.start(), 1, f"access:{m.start()}:{m.end()}", m[0]))
    for m in _HEX.finditer(text):
        found.append((m.start(), 2, f"hex:{m.start()}:{m.end()}", m[0]))
    if "eyJ" in text:
        found += [(m.start(), 3, f"jwt:{m.start()}:{m.end()}", m[0]) for m in _JWT.finditer(text)]
    if "PRIVATE KEY" in text:
        found += [(start, 4, f"pem:{start}:{end}", text[start:end]) for start, end in _keys(text)]
    if "://" in text:
        found += [(m.start(1), 5, f"url:{m.start(1)}:{m.end(1)}", m[1]) for m in _URL.finditer(text)]
    return sorted(found)


def looks_random(value: str) -> bool:
    """At least 2.5 bits a character, as generated keys have and placeholders such as xxxx-1234 have not."""
    n = len(value)
    return n >= 12 and -sum(c / n * math.log2(c / n) for c in Counter(value).values()) >= 2.5


def scan_rows(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_cols: tuple[str, ...]) -> DataFrame:
    """One row a document: id, owner, repo, counts, base_sha256, spans and its candidates; texts stay behind."""
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"),
        F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repo_cols]).alias("repo"),
        F.xxhash64(F.col(text_col)).alias("text_hash"),
        F.col(text_col).cast("string").alias("_text"),
    )
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "owner", "repo", "text_hash", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "candidates"]
    item = pa.struct([("span", pa.string()), ("hash", pa.binary()), ("random", pa.bool_())])
    schema = (
        f"id {kind}, owner string, repo string, text_hash bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string,"
        " spans string, candidates array<struct<span: string, hash: binary, random: boolean>>"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], []]
            digest, spans, candidates = [], [], []
            for text in batch.column("_text"):
                found = scan(text.as_py() or "")
                for k in range(3):
                    counts[k].append(sum(f[1] == k for f in found))
                digest.append(hashlib.sha256(",".join(f[2] for f in found if f[1] < 3).encode()).hexdigest())
                spans.append(",".join(f[2] for f in found))
                candidates.append(
                    [{"span": f[2], "hash": hashlib.sha256(f[3].encode()).digest()[:16], "random": looks_random(f[3])} for f in found]
                )
            columns = [batch.column(c) for c in ("id", "owner", "repo", "text_hash")]
            columns += [pa.array(c, pa.int64()) for c in counts]
            columns += [pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(candidates, pa.list_(item))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, schema)


def ownership(candidates: DataFrame) -> DataFrame:
    """(hash, n_repos, n_owners) from (hash, owner, repo), by distinct values.

    Copies within a repository go in the first, map-side combined step, so a hash that a third of all
    rows carry leaves one row for each of its repositories.
    """
    each = candidates.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one"))
    owners = each.groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    return owners.groupBy("hash").agg(F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"))


def secret_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repo_cols: tuple[str, ...] = ("source", "lang"),
    copied_owners: int = 5,
) -> DataFrame:
    """One row a document: counts, digest and spans of the scan, then the verdicts of the corpus.

    copied: candidates whose value `copied_owners` distinct owners or more hold.
    live: the spans of all other candidates that look random, joined by commas.
    masked: the spans to take out of a text, all but the copied ones.
    text_hash: xxhash64 of the text, to tell rows of one id apart.
    """
    # a row number of its own ties verdicts to rows, whatever ids repeat or are null
    rows = scan_rows(docs, id_col, text_col, owner_col, repo_cols)
    rows = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()))
    each = rows.filter(F.size("candidates") > 0).select("row", "owner", "repo", F.explode("candidates").alias("c"))
    each = each.select("row", "owner", "repo", "c.span", "c.hash", "c.random")
    judged = each.join(ownership(each), "hash").withColumn("copied", F.col("n_owners") >= copied_owners)
    start = F.split("span", ":")[1].cast("int")
    kept = lambda test: F.sort_array(F.collect_list(F.when(test, F.struct(start.alias("s"), "span"))))["span"]
    verdicts = judged.groupBy("row").agg(
        F.count_if("copied").alias("n_copied"),
        F.max("n_owners").alias("most_owners"),
        F.max("n_repos").alias("most_repos"),
        F.array_join(kept(~F.col("copied") & F.col("random")), ",").alias("live"),
        F.array_join(kept(~F.col("copied")), ",").alias("masked"),
    )  # the lists hold one text's spans
    found = rows.join(verdicts, "row", "left").na.fill(0, ["n_copied", "most_owners", "most_repos"]).na.fill("", ["live", "masked"])
    columns = ["base_sha256", "spans", "n_copied", "most_owners", "most_repos", "live", "masked", "text_hash"]
    return found.select("id", *(f"n_{k}" for k in BASE_KINDS), *columns)


def mask(text: str, spans: str, sign: str = "[SECRET]") -> str:
    """The text with the spans, overlapping ones together, replaced."""
    out, at = [], 0
    for start, end in sorted((int(s), int(e)) for _, s, e in (x.split(":") for x in spans.split(","))):
        if start >= at:
            out += [text[at:start], sign]
        at = max(at, end)
    return "".join([*out, text[at:]])
