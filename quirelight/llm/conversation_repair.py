"""Conversations mended by the cheapest edits, found by Hirschberg's divide and conquer.

A conversation is well formed if the initials of its roles read `(s?(ua)+)?`.  Reading it, one is in one of four
states: nothing yet, after a system turn, after a user turn, after an assistant's.  A row is kept, given the other role, or
deleted, and empty turns may be put in front of it; each has its cost.  The state and an edit's initial tell the next
state, so an audit, the initials in order, tells the whole way.  The steps of a row (some insertions, then one of the
others) are a prefix code: of two ways over the same rows, the audits differ before either ends.

Forward, four costs with the rank of their least audits are carried over the first half of a conversation;
backward, four costs over the second half.  Where they meet, the cheapest state, of equals the one with the least
audit, is on the best way; both halves are solved in the same manner between known states, down to blocks of `BLOCK` rows.  Vectors are kept
relative to their least cost, so few differ, and a step is a look-up.

On Spark the same cut deals the work out: rows are range-partitioned by (conversation, turn, role, digest of the text), so a conversation of any
length lies on consecutive partitions.  One that lies across gives four vectors (one a state to begin in) from each partition that holds some
of it: at most two such rows a partition, each of fixed size, tell the driver in which states the ways cross from one to
the next.  Then every partition solves what it holds between known states, and all that it writes are edits in order.

Defined cases: a null role or text is one space; null turns come first; equal turns are ordered by role and digest of the text.  Exact copies of a row are
one row with a number, and all but the first are duplicates.  Roles without a known initial can't be kept, nor can empty ones.  Null ids are
one conversation.  Texts are read whole, however long.  An empty table gives no rows, further columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelight.llm.common import cut_lineage, shuffle_width

KEEP, REROLE, INSERT, DELETE, TRUNCATED = 0, 3, 3, 4, 3
#: Rows that a leaf of the recursion solves with all its choices at hand.
BLOCK = 64
#: Bytes of duplicates' keys up to which they are broadcast; beyond it, they are joined by a shuffle.
BROADCAST_BYTES = 16 << 20
#: Characters of repaired text in one piece of a conversation that lies across partitions.
PIECE = 1 << 20

START, SYSTEM, USER, ASSISTANT = range(4)
_INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_NAMES = {USER: "user", ASSISTANT: "assistant"}
#: The next turn that may be put in or that a row may be made.
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_NEVER = 1 << 40
#: Cost and audit of what has to follow the last row.
END = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))
#: What kind a row is: role (4 values: none of the known, or a state) + 4 * (0 to be deleted, 1 plain, 2 truncated).
KINDS = 12

Way = tuple[int, int]  # cost above the least, rank of the least audit


class Vector(NamedTuple):
    least: int
    ways: tuple[Way, ...]  # one a state


def start_vector(state: int) -> Vector:
    return Vector(0, tuple((0, 0) if s == state else (_NEVER, 3) for s in range(4)))


@cache
def steps(kind: int) -> tuple[tuple[tuple[int, str] | None, ...], ...]:
    """(cost, audit) from each state to each state over a row: the cheapest, of equals the least audit."""
    role, fate = kind % 4, kind // 4
    found: list[list[tuple[int, str] | None]] = [[None] * 4 for _ in range(4)]
    for i in range(4):
        at = i
        for inserts in range(3):
            ends = [(DELETE, "D", at)]
            if fate:
                more = TRUNCATED if fate == 2 else 0
                if role == SYSTEM and at == START or role == USER and at != USER or role == ASSISTANT and at == USER:
                    ends.append((KEEP + more, "K", role))
                ends.append((REROLE + more, "R", _NEXT[at]))
            for cost, sign, j in ends:
                way = (cost + INSERT * inserts, "I" * inserts + sign)
                if found[i][j] is None or way < found[i][j]:
                    found[i][j] = way
            at = _NEXT[at]
    return tuple(map(tuple, found))


@cache
def _forward(ways: tuple[Way, ...], kind: int) -> tuple[int, tuple[Way, ...], tuple[int, ...]]:
    """(what the least cost grows by, the ways after a row of this kind, the state before on the best way to each)."""
    best = []
    for j in range(4):
        options = [(cost + s[0], rank, s[1], i) for i, (cost, rank) in enumerate(ways) if cost < _NEVER and (s := steps(kind)[i][j])]
        best.append(min(options) if options else (_NEVER, 4, "", -1))
    least = min(b[0] for b in best)
    order = sorted(range(4), key=lambda j: best[j][1:3])
    return least, tuple((b[0] - least if b[0] < _NEVER else _NEVER, order.index(j) if b[0] < _NEVER else 3) for j, b in enumerate(best)), tuple(b[3] for b in best)


@cache
def _backward(costs: tuple[int, ...], kind: int) -> tuple[int, tuple[int, ...]]:
    """The same from the end: costs to go before a row of this kind, from those after it."""
    best = [min([costs[j] + s[0] for j in range(4) if costs[j] < _NEVER and (s := steps(kind)[i][j])], default=_NEVER) for i in range(4)]
    least = min(best)
    return least, tuple(b - least if b < _NEVER else _NEVER for b in best)


def forward(vector: Vector, kinds: np.ndarray) -> Vector:
    least, ways = vector
    for kind in kinds.tolist():
        more, ways, _ = _forward(ways, kind)
        least += more
    return Vector(least, ways)


def _leaf(kinds: list[int], state: int, end: int, out: list[str]) -> None:
    ways, before = start_vector(state).ways, []
    for kind in kinds:
        _, ways, came = _forward(ways, kind)
        before.append(came)
    at, found = end, []
    for kind, came in zip(reversed(kinds), reversed(before), strict=True):
        found.append(steps(kind)[came[at]][at][1])
        at = came[at]
    out += reversed(found)


def solve(kinds: np.ndarray, state: int, end: int, out: list[str]) -> None:
    """Puts the audit of each row on the best way from state to end into out."""
    if len(kinds) <= BLOCK:
        _leaf(kinds.tolist(), state, end, out)
        return
    half = len(kinds) // 2
    ways = forward(start_vector(state), kinds[:half]).ways
    costs = tuple(0 if s == end else _NEVER for s in range(4))
    for kind in reversed(kinds[half:].tolist()):
        _, costs = _backward(costs, kind)
    crossing = min((ways[s][0] + costs[s], ways[s][1], s) for s in range(4) if max(ways[s][0], costs[s]) < _NEVER)[2]
    solve(kinds[:half], state, crossing, out)
    solve(kinds[half:], crossing, end, out)


def best_end(vector: Vector) -> int:
    """The state that the best way of a whole conversation is in after its last row."""
    return min((cost + END[s][0], rank, s) for s, (cost, rank) in enumerate(vector.ways) if cost < _NEVER)[2]


def crossings(segments: list[list[Vector]]) -> list[int]:
    """The states before, between and after the segments of one conversation, from the vectors of each by its first state."""
    vector, before = start_vector(START), []
    for by_state in segments:
        best = []
        for j in range(4):
            options = [(cost + by_state[i].least + by_state[i].ways[j][0], rank, by_state[i].ways[j][1], i) for i, (cost, rank) in enumerate(vector.ways) if max(cost, by_state[i].ways[j][0]) < _NEVER]
            best.append(min(options) if options else (_NEVER, 4, 4, -1))
        order = sorted(range(4), key=lambda j: best[j][1:3])
        before.append([b[3] for b in best])
        vector = Vector(0, tuple((b[0] if b[0] < _NEVER else _NEVER, order.index(j) if b[0] < _NEVER else 3) for j, b in enumerate(best)))
    states = [best_end(vector)]
    for came in reversed(before):
        states.append(came[states[-1]])
    return states[::-1]


_BLANK = r"[^\x20\x09-\x0D]"
_ORDER = ("id", "turn", "role", "digest")


def _turn_key(turn: Column) -> Column:
    return F.struct(turn.isNotNull().alias("told"), turn.alias("turn"))


def placed_rows(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(id, turn, role, text, digest, n, kind, fault), each partition sorted and beginning where the one before ends; n counts exact copies."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = rows.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), cell(role_col).alias("role"), cell(text_col).alias("text"))
    own = own.groupBy("id", "turn", "role", "text").agg(F.count("*").alias("n")).withColumn("digest", F.sha2("text", 256))
    own = cut_lineage(own)
    # few keys recur at another turn; the first of these is no duplicate
    again = own.groupBy("id", "role", "digest").agg(F.count("*").alias("turns"), F.min(_turn_key(F.col("turn"))).alias("first")).filter("turns > 1")
    again = cut_lineage(again.select(F.col("id").alias("_id"), F.col("role").alias("_role"), F.col("digest").alias("_digest"), "first"))
    size = again.agg(F.coalesce(F.sum(F.octet_length("_role") + 160), F.lit(0))).first()[0]
    again = F.broadcast(again) if size <= BROADCAST_BYTES else again
    same = own["id"].eqNullSafe(again["_id"]) & (own["role"] == again["_role"]) & (own["digest"] == again["_digest"])
    own = own.join(again, same, "left")
    last = F.right(F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     ")), F.lit(1))
    blank = ~F.regexp_like("text", F.lit(_BLANK))
    seen = F.col("first").isNotNull() & (_turn_key(F.col("turn")) > F.col("first"))
    fault = F.when(blank, "blank").when(seen, "duplicate").when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    own = own.withColumn("fault", fault)
    fate = F.when(F.col("fault").isin("blank", "duplicate"), 0).when(F.col("fault") == "truncated", 2).otherwise(1)
    initial = F.left("role", F.lit(1))
    role = F.coalesce(*[F.when(initial == sign, state) for sign, state in _INITIALS.items()], F.lit(0))
    own = own.select("id", "turn", "role", "text", "digest", "n", (role + 4 * fate).cast("int").alias("kind"), "fault")
    # all the way to the digest, so that even a turn that most rows have is cut; equal keys are one row
    spread = own.repartitionByRange(shuffle_width(rows.sparkSession), *_ORDER).sortWithinPartitions(*_ORDER)
    return cut_lineage(spread)


def _boundaries(rows: DataFrame) -> list[dict]:
    """Of each partition its first and its last conversation: id, vectors by the state before, first and last role, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        firsts: list[tuple[object, list[np.ndarray], str]] = []  # the first conversation, then the present one
        last_role = ""
        for batch in batches:
            ids, kinds, roles = batch.column("id").to_pylist(), batch.column("kind").to_numpy(), batch.column("role")
            for begin, end in _runs(ids):
                if not firsts or firsts[-1][0] != ids[begin]:
                    firsts = [*firsts[:1], (ids[begin], [], roles[begin].as_py())]
                firsts[-1][1].append(kinds[begin:end])
            last_role = roles[-1].as_py() if ids else last_role
        rows = []
        for k, (key, parts, role) in enumerate(firsts):
            kinds = np.concatenate(parts)
            found = [forward(start_vector(s), kinds) for s in range(4)]
            flat = [x for v in found for x in (v.least, *(y for way in v.ways for y in way))]
            rows.append((TaskContext.get().partitionId(), k, len(firsts), key, role[:1], last_role[:1], flat))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 7
        kinds_of = [pa.int32(), pa.int32(), pa.int32(), id_type, pa.string(), pa.string(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds_of, strict=True)], names=["run", "place", "of", "id", "first", "last", "flat"])

    kind = rows.schema["id"].dataType.simpleString()
    id_type = rows.select("id").limit(0).toArrow().schema.field("id").type
    found = rows.select("id", "kind", "role").mapInArrow(run, f"run int, place int, of int, id {kind}, first string, last string, flat array<bigint>")
    return sorted((r.asDict() for r in found.collect()), key=lambda r: (r["run"], r["place"]))


def _runs(ids: list) -> Iterator[tuple[int, int]]:
    """Where equal neighbours begin and end."""
    begin = 0
    for k in range(1, len(ids) + 1):
        if k == len(ids) or ids[k] != ids[begin]:
            yield begin, k
            begin = k


def _between(boundaries: list[dict]) -> dict[tuple[int, int], tuple[int, int, str, bool, bool]]:
    """For the conversations that lie across partitions, by partition and place (0 first, 1 last): the states before and after, the role initial before, and whether they begin and end there."""
    found, chain = {}, []

    def settle() -> None:
        if len(chain) > 1:
            vectors = [[Vector(f[0], tuple(zip(f[1::2], f[2::2], strict=True))) for f in (r["flat"][9 * s : 9 * s + 9] for s in range(4))] for r in chain]
            states = crossings(vectors)
            for k, r in enumerate(chain):
                found[r["run"], r["place"]] = (states[k], states[k + 1], chain[k - 1]["last"] if k else "", k == 0, k == len(chain) - 1)
        chain.clear()

    for r in boundaries:
        if not chain or chain[-1]["id"] != r["id"] or r["place"]:
            settle()
        chain.append(r)
    settle()
    return found


def repaired(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The edits in order: (id, run, place, turn, edit, times, role, text, fault, illegal, whole).

    run and place order the edits of a conversation; edit is K, R, I or D, done `times` times (deleted copies are one row).  role and text are those of the
    repaired turn, null where it was deleted; turn and fault those of the source row, null for an inserted turn.  illegal counts the neighbours in
    the source, up to this row, whose role initials may not follow each other; whole tells that no other run has edits of the conversation.
    """
    placed = placed_rows(rows, id_col, turn_col, role_col, text_col)
    across = _between(_boundaries(placed))
    kinds_of = {c: placed.schema[c].dataType.simpleString() for c in ("id", "turn")}
    types = placed.select("id", "turn").limit(0).toArrow().schema
    schema = f"id {kinds_of['id']}, run int, place bigint, turn {kinds_of['turn']}, edit string, times bigint, role string, text string, fault string, illegal bigint, whole boolean"
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    arrow = [types.field("id").type, pa.int32(), pa.int64(), types.field("turn").type, pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, segment, seen = TaskContext.get().partitionId(), [], 0

        def edits(held: list[pa.RecordBatch], known: tuple | None) -> Iterator[pa.RecordBatch]:
            kinds = np.concatenate([b.column("kind").to_numpy() for b in held])
            state, end, before, begins, ends = known or (START, best_end(forward(start_vector(START), kinds)), "", True, True)
            audits: list[str] = []
            solve(kinds, state, end, audits)
            at, place, k = state, 0, 0
            for batch in held:
                out: list[tuple] = []
                for key, turn, role, text, n, fault in zip(*(batch.column(c).to_pylist() for c in ("id", "turn", "role", "text", "n", "fault")), strict=True):
                    illegal = n - 1 + (not (begins and k == 0) and before + role[:1] not in ("su", "ua", "au"))
                    for sign in audits[k]:
                        if sign == "D":
                            out.append((key, turn, "D", 1, None, None, fault, illegal))
                            continue
                        if sign == "K":
                            at = _INITIALS[role[0]]
                            out.append((key, turn, "K", 1, role, text, fault, illegal))
                        else:
                            at = _NEXT[at]
                            new = (key, turn, "R", 1, _NAMES[at], text, fault, illegal) if sign == "R" else (key, None, "I", 1, _NAMES[at], "", None, 0)
                            out.append(new)
                    if n > 1:
                        out.append((key, turn, "D", n - 1, None, None, fault if fault == "blank" else "duplicate", 0))
                    before, k = role[:1], k + 1
                if ends and k == len(kinds):
                    for _ in END[at][1]:
                        at = _NEXT[at]
                        out.append((batch.column("id")[0].as_py(), None, "I", 1, _NAMES[at], "", None, 0))
                columns = list(zip(*[(r[0], number, place + x, *r[1:], begins and ends) for x, r in enumerate(out)], strict=True))
                place += len(out)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow, strict=True)], names=names)

        for batch in batches:
            ids = batch.column("id").to_pylist()
            for begin, end in _runs(ids):
                if segment and segment[0].column("id")[0].as_py() != ids[begin]:
                    yield from edits(segment, across.get((number, 0)) if not seen else None)
                    segment, seen = [], seen + 1
                segment.append(batch.slice(begin, end - begin))
        if segment:
            yield from edits(segment, across.get((number, min(seen, 1))))

    return placed.select("id", "turn", "role", "text", "n", "kind", "fault").mapInArrow(run, schema)


def reports(edits: DataFrame) -> DataFrame:
    """(id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation with edits, from what repaired() gives.

    A conversation within one run is summed up there.  One across several comes in pieces of bounded size, in order; its digest
    is one chain over all its bytes, so the pieces of one conversation end in one task, which reads them as a stream.
    """
    kinds_of = {c: edits.schema[c].dataType.simpleString() for c in ("id", "turn")}
    types = edits.select("id", "turn").limit(0).toArrow().schema
    counted = ("blank", "duplicate", "truncated", "illegal", "cost", "turns")
    names = ["id", "run", "piece", *counted, "low", "high", "audit", "text", "digest"]
    arrow = [types.field("id").type, pa.int32(), pa.int32(), *[pa.int64()] * 6, types.field("turn").type, types.field("turn").type, pa.string(), pa.string(), pa.string()]
    price = {"K": KEEP, "R": REROLE, "I": INSERT, "D": DELETE}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None

        def piece(last: bool) -> pa.RecordBatch:
            if now["whole"] and last:
                now["hash"].update("".join(now["lines"]).encode())
                text, digest = None, now["hash"].hexdigest()
            else:
                text, digest = "".join(now["lines"]), None
            row = [now["id"], now["run"], now["piece"], *(now[c] for c in counted), now["low"], now["high"], "".join(now["audit"]), text, digest]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, arrow, strict=True)], names=names)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("id", "run", "turn", "edit", "times", "role", "text", "fault", "illegal", "whole")), strict=True):
                key, number, turn, edit, times, role, text, fault, illegal, whole = row
                if now is None or now["id"] != key:
                    if now is not None:
                        yield piece(True)
                    now = dict.fromkeys(counted, 0) | {"id": key, "run": number, "whole": whole, "piece": 0, "low": None, "high": None, "audit": [], "lines": [], "size": 0, "hash": hashlib.sha256(), "any": False}
                if fault:
                    now[fault] += times
                now["illegal"] += illegal
                now["cost"] += times * price[edit] + (TRUNCATED if fault == "truncated" and edit != "D" else 0)
                now["audit"].append(edit * times)
                if turn is not None and turn != now["high"]:
                    now["turns"], now["high"] = now["turns"] + 1, turn
                    now["low"] = turn if now["low"] is None else now["low"]
                if role is not None:
                    # a line of a later piece follows another one; the first piece with a line has none before it
                    line = f"\n{role}:{text}" if now["any"] or not whole else f"{role}:{text}"
                    now["any"] = True
                    now["lines"].append(line)
                    now["size"] += len(line)
                if now["size"] > PIECE or len(now["audit"]) > PIECE:
                    if whole:
                        now["hash"].update("".join(now["lines"]).encode())
                        now["lines"], now["size"] = [], 0
                    if not whole:
                        yield piece(False)
                        now |= dict.fromkeys(counted, 0) | {"piece": now["piece"] + 1, "audit": [], "lines": [], "size": 0}
        if now is not None:
            yield piece(True)

    schema = f"id {kinds_of['id']}, run int, piece int, " + ", ".join(f"{c} bigint" for c in counted) + f", low {kinds_of['turn']}, high {kinds_of['turn']}, audit string, text string, digest string"
    # edits come in the order of their partitions, so no sort is needed here
    pieces = edits.mapInArrow(run, schema)
    pieces = pieces.repartition(shuffle_width(edits.sparkSession), "id").sortWithinPartitions("id", "run", "piece")
    final = ["id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None
        done: list[list] = []

        def close() -> None:
            gaps = 0 if now["high"] is None else now["high"] - now["low"] + 1 - now["turns"]
            digest = now["digest"] or now["hash"].hexdigest()
            done.append([now["id"], gaps, *(now[c] for c in counted[:5]), "".join(now["audit"]), digest])

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [types.field("id").type, *[pa.int64()] * 6, pa.string(), pa.string()], strict=True)], names=final)

        for batch in batches:
            for row in batch.to_pylist():
                if now is None or now["id"] != row["id"]:
                    if now is not None:
                        close()
                    now = row | {"audit": [row["audit"]], "hash": hashlib.sha256()}
                    rest = (row["text"] or "")[1:]  # no line feed before the first line
                    now["began"] = bool(row["text"])
                    now["hash"].update(rest.encode())
                    continue
                for c in counted[:5]:
                    now[c] += row[c]
                # a turn that the piece before ends with is counted there
                if row["low"] is not None:
                    now["turns"] += row["turns"] - (row["run"] != now["run"] and row["low"] == now["high"])
                    now["low"] = row["low"] if now["low"] is None else now["low"]
                    now["high"] = row["high"]
                now["run"] = row["run"]
                now["audit"].append(row["audit"])
                text = row["text"] or ""
                now["hash"].update((text if now["began"] else text[1:]).encode())
                now["began"] = now["began"] or bool(text)
            if done:
                yield flush()
        if now is not None:
            close()
            yield flush()

    return pieces.mapInArrow(join, f"id {kinds_of['id']}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string")


def damaged(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows with planted faults, by crc32(`id:turn`) % 20: 0 drops the row, 1 empties its text, 2 takes out its sentence ends, 3 repeats it, 4 makes it the user's."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(cell(id_col), F.lit(":"), cell(turn_col)).cast("binary")) % 20
    own = rows.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), cell(role_col).alias("role"), cell(text_col).alias("text"), lot.alias("_lot")).filter("_lot != 0")
    text = F.when(F.col("_lot") == 1, "").when(F.col("_lot") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("_lot") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return own.select("conv_id", "turn", F.when(F.col("_lot") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")
