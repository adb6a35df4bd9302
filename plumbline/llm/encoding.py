"""Token ids of whole texts by a public byte-level vocabulary, without regular expressions."""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.session import ship_file, shipped_file

#: The rank file of byte_bpe_50k; a parameter of every function below.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pieces remembered by a worker, and code points that are classified at once.
CACHE, BLOCK = 400_000, 1 << 20

# Symbols of the transition functions: what a code point is, given what follows it.
LETTER, NUMBER, OTHER, SHORT, LONG, SPACES, BLANK, LAST = range(8)
# States after a code point: nothing open, or an open run, a blank that waits for its run, a contraction with 1 or 2 letters left.
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACES, WAITING, ONE_LEFT, TWO_LEFT = range(8)


@lru_cache(1)
def _classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or SPACES of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    # White_Space of Unicode.
    for c in [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]:
        table[c] = SPACES
    return table


@lru_cache(1)
def _machine() -> tuple[np.ndarray, np.ndarray]:
    """next[symbol, state] and cut[symbol, state]: the state after the symbol, and whether a piece starts with it. Symbols
    from 8 on are the same ones at the start of a text."""
    nxt, cut = np.zeros((16, 8), np.uint8), np.ones((16, 8), bool)
    run = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS}
    for state in range(8):
        for symbol, inside in run.items():
            nxt[symbol, state] = inside
            cut[symbol, state] = state not in (inside, WAITING)
        if state in (ONE_LEFT, TWO_LEFT):  # only letters can follow here
            nxt[LETTER, state], cut[LETTER, state] = (START, False) if state == ONE_LEFT else (ONE_LEFT, False)
        for symbol, inside in ((SHORT, ONE_LEFT), (LONG, TWO_LEFT)):
            goes_on = state in (IN_OTHERS, WAITING)
            nxt[symbol, state], cut[symbol, state] = (IN_OTHERS, False) if goes_on else (inside, True)
        nxt[SPACES, state], cut[SPACES, state] = IN_SPACES, state != IN_SPACES
        nxt[BLANK, state] = WAITING
        nxt[LAST, state] = START
    nxt[8:], cut[8:] = nxt[:8, START : START + 1], True
    return nxt, cut


def piece_starts(code: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions at which pieces start, for texts laid end to end (``first`` marks the first code point of each).

    Each code point is a function from states to states; functions compose associatively, so blocks are composed side
    by side and only their few results are chained, then all states follow at once.
    """
    n = len(code)
    if not n:
        return np.zeros(0, np.int64)
    symbol = _classes()[code]
    ends = np.append(first[1:], True)  # the last code point of its text
    after = np.append(symbol[1:], SPACES)
    space = symbol == SPACES
    last = space & ~ends & (after != SPACES)
    symbol[last] = LAST
    symbol[last & (code == 0x20)] = BLANK
    quote = np.flatnonzero((code == 0x27) & ~ends)
    if len(quote):
        padded, bounds = np.append(code, [0, 0]), np.append(ends, [True, True])
        a, b = padded[quote + 1], np.where(bounds[quote + 1], 0, padded[quote + 2])
        symbol[quote[np.isin(a, [ord(x) for x in "stmd"])]] = SHORT
        pair = a.astype(np.int64) * 0x110000 + b
        symbol[quote[np.isin(pair, [ord(x) * 0x110000 + ord(y) for x, y in ("re", "ve", "ll")])]] = LONG
    symbol = symbol + np.where(first, 8, 0).astype(np.uint8)
    nxt, cut = _machine()
    width = max(1, int(n**0.5))
    rows = -(-n // width)
    grid = np.zeros(rows * width, np.uint8)
    grid[:n] = symbol
    grid = grid.reshape(rows, width)
    whole = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    for k in range(width):
        whole = nxt[grid[:, k, None], whole]
    state = np.zeros(rows, np.uint8)
    for r in range(1, rows):
        state[r] = whole[r - 1, state[r - 1]]
    starts = np.zeros((rows, width), bool)
    for k in range(width):
        starts[:, k] = cut[grid[:, k], state]
        state = nxt[grid[:, k], state]
    return np.flatnonzero(starts.reshape(-1)[:n])


class Encoder:
    """Ids of texts: pieces by transition scans, cached merges of byte pairs by rank within each piece."""

    def __init__(self, ranks_file: str = RANKS) -> None:
        with open(ranks_file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.cache: dict[str, list[int]] = {}
        self.bytes_of = {r: b for b, r in self.ranks.items()}

    def merge(self, piece: bytes) -> list[int]:
        """Merges the pair of lowest rank, leftmost first, until none is left; with a heap, so long pieces stay cheap."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        end = list(range(1, n + 1))  # the part at i covers i..end[i]
        before = list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            j = end[i]
            alive[j] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids."""
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")

    def places(self, ids: list[int]) -> list[int]:
        """For each id of a piece the code point, from the piece's start, that holds its first byte."""
        out, n = [], 0
        for i in ids:
            part = self.bytes_of[i]
            out.append(n - (part[0] & 0xC0 == 0x80))
            n += sum(b & 0xC0 != 0x80 for b in part)
        return out

    def encode(self, texts: list[str | None], offsets: bool = False) -> Iterator[tuple[list[int], list[int]]]:
        """(ids, starts) of each text; starts (if asked for) has the code point that holds each id's first byte."""
        block: list[str] = []
        size = 0
        for text in texts:
            block.append(text or "")
            size += len(block[-1])
            if size >= BLOCK:
                yield from self._block(block, offsets)
                block, size = [], 0
        yield from self._block(block, offsets)

    def _block(self, texts: list[str], offsets: bool) -> Iterator[tuple[list[int], list[int]]]:
        joined = "".join(texts)
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        first = np.zeros(len(code), bool)
        begin = ends - np.array([len(t) for t in texts], dtype=np.int64)
        first[begin[begin < ends]] = True
        starts = piece_starts(code, first)
        split = np.searchsorted(starts, ends)
        places = np.append(starts, len(code)).tolist()
        cache, at = self.cache, 0
        for k, stop in enumerate(split.tolist()):
            ids: list[int] = []
            where: list[int] = []
            for i in range(at, stop):
                piece = joined[places[i] : places[i + 1]]
                got = cache.get(piece)
                if got is None:
                    got = self.merge(piece.encode("utf-8", "replace"))
                    if len(piece) < 64:
                        if len(cache) >= CACHE:
                            cache.clear()
                        cache[piece] = got
                ids += got
                if offsets:
                    base = places[i] - int(begin[k])
                    where += [base] if len(got) == 1 else [base + x for x in self.places(got)]
            at = stop
            yield ids, where


@lru_cache(2)
def encoder(ranks_file: str = RANKS) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    return Encoder(ranks_file)


def encode_documents(documents: DataFrame, ranks_file: str = RANKS, offsets: bool = False) -> DataFrame:
    """(doc_id, ids) of every document's text, with ``starts`` if offsets are wanted: for each id the code point of the text that
    holds its first byte. Null and empty texts have no ids. ``Encoder.decode`` gives the text back.

    A narrow plan: one pass, no shuffle, only doc_id and text are read. Repeated rows come out repeatedly.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shipped_file(ranks_file))
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                got = list(enc.encode(part.column("text").to_pylist(), offsets))
                cols = {"doc_id": part.column("doc_id"), "ids": pa.array([g[0] for g in got], pa.list_(pa.int32()))}
                if offsets:
                    cols["starts"] = pa.array([g[1] for g in got], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(cols)

    rows = documents.select("doc_id", "text")
    ship_file(rows.sparkSession, ranks_file)
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, ids array<int>" + ", starts array<int>" * offsets)


def token_counts(documents: DataFrame, columns: list[str], ranks_file: str = RANKS) -> DataFrame:
    """``columns`` of documents with n_tokens, the number of ids of text (0 for null and empty texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shipped_file(ranks_file))
        for batch in batches:
            sizes = pa.array([len(ids) for ids, _ in enc.encode(batch.column("text").to_pylist())], pa.int64())
            yield batch.select(columns).append_column("n_tokens", sizes)

    rows = documents.select(*columns, *[c for c in ("text",) if c not in columns])
    ship_file(rows.sparkSession, ranks_file)
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.select(*columns).dtypes) + ", n_tokens long"
    return rows.mapInArrow(run, schema)
