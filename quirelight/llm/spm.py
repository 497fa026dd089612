"""SentencePiece BPE encoding and decoding with a merge-type prefix table.

For every prefix of a text, BPE leaves exactly one last token.  An automaton yields the pieces
that end at a position; the one that is compatible with the last token of the prefix before it
(the pair, merged on its own, stays that pair) is the last token there.  The ids are read off
backwards.  Texts are cut where no piece can span: before a run of spaces and at line feeds, so that
the encodings of words are kept in a bounded memo.

A few pieces share one score (runs of spaces); among equals the leftmost pair merges first, which
prefixes cannot tell, so such runs are merged by a heap once the rest stands.

Defined cases: null and empty texts have no ids and decode to the empty text; every byte outside
the vocabulary becomes its byte piece; repeated rows are encoded each; rows keep their id, null too.
Texts are encoded whole, however long; an empty table gives no rows; columns that are not kept are not read, and kept
ones must not have the name of an output.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelight.llm.common import freed

SPACE = "▁"
#: Words whose encoding a worker keeps, in each of two generations; the older one goes when the younger is full.
MEMO_WORDS = 300_000
MEMO_PAIRS = 300_000

_COLUMNS = {
    "ids": "array<int>",
    "n_tokens": "bigint",
    "ids_sha256": "string",
    "decoded": "string",
    "decoded_sha256": "string",
}
_ARROW = {"bigint": pa.int64(), "string": pa.string()}


def _each_bad_byte(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("quirelight_bytes", _each_bad_byte)


class PieceTable:
    """The vocabulary of one model and the encodings of words by it."""

    def __init__(self, proto: bytes):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        size = model.get_piece_size()
        self.byte_ids: dict[int, int] = {}
        self.ids: dict[str, int] = {}
        self.bytes_of: dict[str, bytes] = {}
        scores: dict[int, float] = {}
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.bytes_of[str(i)] = bytes([value])
            elif model.is_control(i):
                self.bytes_of[str(i)] = b""
            elif model.is_unknown(i):
                self.bytes_of[str(i)] = " ⁇ ".encode()
            else:
                self.ids[piece] = i
                scores[i] = model.get_score(i)
                self.bytes_of[str(i)] = piece.replace(SPACE, " ").encode()
        if any(SPACE in piece.lstrip(SPACE) for piece in self.ids):
            raise ValueError("pieces span words; this vocabulary can't be cut at spaces")
        shared = Counter(scores[i] for p, i in self.ids.items() if len(p) > 1)
        self.rank = {i: -score for i, score in scores.items()}
        self.tied = {p for p, i in self.ids.items() if len(p) > 1 and shared[scores[i]] > 1}
        if any(p.strip(SPACE) for p in self.tied):
            raise ValueError("pieces other than runs of spaces share a score")
        self.text_of = {i: p for p, i in self.ids.items()}
        self.halves: dict[int, tuple[int, int]] = {}  # what the last merge of a piece joins
        self.joined: dict[int, float] = {}  # rank of the piece that two pieces make
        self.automaton = ahocorasick.Automaton()
        self.odd: list[str] = []
        for piece, i in self.ids.items():
            if piece in self.tied:
                continue
            whole, history, halves = self._merge(piece, False)
            if whole == [piece]:
                self.automaton.add_word(piece, (i, len(piece)))
                if history:
                    self.halves[i] = (self.ids[halves[0]], self.ids[halves[1]])
                    if history != sorted(history):
                        self.odd.append(piece)
            for k in range(1, len(piece)):
                left, right = self.ids.get(piece[:k]), self.ids.get(piece[k:])
                if left is not None and right is not None:
                    self.joined[left << 32 | right] = self.rank[i]
        for i in self.text_of:
            if i not in self.halves:
                self.rank[i] = -1.0  # characters stand from the start
        self.automaton.make_automaton()
        self.odd_pattern = re.compile("|".join(map(re.escape, self.odd))) if self.odd else None
        self.pairs: dict[int, bool] = {}
        self.memo: dict[str, str] = {}
        self.older: dict[str, str] = {}

    def merged(self, text: str, ties: bool = False) -> list[str]:
        """Plain BPE by a heap of pairs, best score first, leftmost among equals."""
        return self._merge(text, ties)[0]

    def _merge(self, text: str, ties: bool) -> tuple[list[str], list[float], tuple[str, str]]:
        """The symbols that stay, the ranks of the merges in their order, and the halves of the last merge."""
        symbols: list[str | None] = list(text)
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        heap: list[tuple[float, int, str]] = []
        history: list[float] = []
        halves = ("", "")

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else len(symbols)
            if j < len(symbols):
                both = symbols[i] + symbols[j]
                found = self.ids.get(both)
                if found is not None and (ties or both not in self.tied):
                    heapq.heappush(heap, (self.rank[found], i, both))

        for i in range(len(symbols)):
            offer(i)
        while heap:
            rank, i, both = heapq.heappop(heap)
            if symbols[i] is None or after[i] >= len(symbols) or symbols[i] + symbols[after[i]] != both:
                continue
            j = after[i]
            halves = (symbols[i], symbols[j])
            symbols[i], symbols[j], after[i] = both, None, after[j]
            if after[i] < len(symbols):
                before[after[i]] = i
            history.append(rank)
            offer(i)
            offer(before[i])
        return [x for x in symbols if x is not None], history, halves

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two pieces, written together, stay two pieces.

        Their merges are undone from the last to the first.  At each step the tokens beside the
        border must not join before the merge just undone; among equal ranks the left one is first.
        """
        if len(self.pairs) >= MEMO_PAIRS:
            self.pairs.clear()
        fits = self.pairs[left << 32 | right] = self._apart(left, right)
        return fits

    def _apart(self, left: int, right: int) -> bool:
        rank, joined, limit = self.rank, self.joined, float("inf")
        while True:
            across = joined.get(left << 32 | right)
            if across is not None and across < limit:
                return False
            a, b = rank[left], rank[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, left = a, self.halves[left][1]
            else:
                limit, right = b + 0.5, self.halves[right][0]

    def prefix_table(self, text: str) -> list[tuple[int, int]]:
        """For each prefix, the id and the length of its last token; id -1: a character without a piece."""
        last = [(-2, 0)] + [(-1, 1)] * len(text)
        known, compatible = self.pairs.get, self.compatible
        settled = -1
        for end, token in self.automaton.iter(text):
            if settled == end:
                continue
            i, length = token
            before = last[end + 1 - length][0]
            if before >= 0:
                fits = known(before << 32 | i)
                if fits is None:
                    fits = compatible(before, i)
                if not fits:
                    continue
            last[end + 1] = token
            settled = end
        return last

    def tokens(self, text: str) -> list[int]:
        """Ids of a text between two cuts; spaces are already written as U+2581."""
        body = text.lstrip(SPACE)
        spaces = len(text) - len(body)
        word = SPACE + body if spaces and body else body
        out: list[int] = []
        if word and self.odd_pattern and self.odd_pattern.search(word):
            for piece in self.merged(word):
                out += [self.ids[piece]] if piece in self.ids else self.of_bytes(piece)
        elif word:
            last, end = self.prefix_table(word), len(word)
            while end:
                i, length = last[end]
                out += [i] if i >= 0 else self.of_bytes(word[end - 1])[::-1]
                end -= length
            out.reverse()
        lone = self.ids.get(SPACE)
        if body and spaces:
            spaces -= 1
            if out[0] == lone and spaces:
                spaces, out = spaces + 1, out[1:]
        if spaces:
            out = [self.ids[p] for p in self.merged(SPACE * spaces, ties=True)] + out
        return out

    def of_bytes(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode()]

    def encode(self, text: str) -> str:
        """The ids in decimal, joined by commas."""
        if not text:
            return ""
        memo, out = self.memo, []
        for chunk in _CHUNKS.findall(SPACE + text.replace(" ", SPACE)):
            known = memo.get(chunk)
            if known is None:
                known = self.older.get(chunk) or ",".join(map(str, self.tokens(chunk)))
                if len(chunk) <= 64:
                    if len(memo) >= MEMO_WORDS:
                        self.older = memo
                        memo = self.memo = {}
                    memo[chunk] = known
            out.append(known)
        return ",".join(out)

    def decode(self, ids: str) -> str:
        """The text of comma-joined ids, without the space that encoding put in front."""
        if not ids:
            return ""
        raw = b"".join(map(self.bytes_of.__getitem__, ids.split(",")))
        return raw.removeprefix(b" ").decode("utf-8", "quirelight_bytes")


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.empty(0, np.int32)))


#: No piece spans these cuts; line feeds are byte pieces where the vocabulary has none of its own.
_CHUNKS = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")

_TABLES: dict[bytes, PieceTable] = {}


def piece_table(proto: bytes) -> PieceTable:
    """One table a worker and model."""
    key = hashlib.sha256(proto).digest()
    if key not in _TABLES:
        _TABLES[key] = PieceTable(proto)
        if any("\n" in piece for piece in _TABLES[key].ids):
            raise ValueError("pieces hold line feeds; this vocabulary can't be cut there")
    return _TABLES[key]


def model_bytes(path: str) -> bytes:
    """The model file, read where the query is planned; half a megabyte goes along with the tasks."""
    with open(path, "rb") as file:
        return file.read()


def sentencepiece_round_trip(
    docs: DataFrame,
    model_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    outputs: tuple[str, ...] = ("ids", "n_tokens", "decoded"),
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Encodes each text, then decodes the ids.  One pass over the rows and no shuffle.

    outputs: any of ids, n_tokens, ids_sha256 (of the comma-joined ids), decoded, decoded_sha256.
    keep: further columns of docs that go along unchanged.
    """
    proto = model_bytes(model_path)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    if keep:
        rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), *keep)
    kinds = {**{c: docs.schema[c].dataType.simpleString() for c in keep}}
    id_kind = docs.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"`{id_col}` {id_kind}", *(f"`{c}` {kinds[c]}" for c in keep), *(f"`{c}` {_COLUMNS[c]}" for c in outputs)])
    wants_text = "decoded" in outputs or "decoded_sha256" in outputs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_table(proto)
        for batch in batches:
            made: dict[str, list] = {c: [] for c in outputs}
            for text in batch.column("_text"):
                ids = pieces.encode(text.as_py() or "")
                decoded = pieces.decode(ids) if wants_text else ""
                for c in outputs:
                    if c == "ids":
                        made[c].append(np.fromstring(ids, np.int32, sep=","))
                    elif c == "n_tokens":
                        made[c].append(ids.count(",") + 1 if ids else 0)
                    elif c == "ids_sha256":
                        made[c].append(hashlib.sha256(ids.encode()).hexdigest())
                    elif c == "decoded":
                        made[c].append(decoded)
                    else:
                        made[c].append(hashlib.sha256(decoded.encode()).hexdigest())
            columns = [batch.column("_id"), *(batch.column(c) for c in keep)]
            columns += [_lists(made[c]) if c == "ids" else pa.array(made[c], _ARROW[_COLUMNS[c]]) for c in outputs]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, *keep, *outputs])

    return rows.mapInArrow(freed(run), schema)
