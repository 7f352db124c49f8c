"""Byte-level BPE: encode whole texts to token ids and decode them again.

Pre-tokenisation uses no regex. Every code point gets a class; a class is a function from the state
before a character to the state after it. Those functions form a small closed set under composition,
so a text's states come from an associative scan over function numbers: inside blocks row by row,
then over block totals by doubling. A boundary is a property of (state, class). The slices between
boundaries go through a cache of merged pieces.

Defined results: a null text encodes as an empty one; an empty text has no tokens; repeated rows are
encoded each on its own; other columns pass through unchanged (a clash with an output name raises
ValueError). A text is handled whole, so memory is bounded by the longest text and the batch.
"""

from __future__ import annotations

import base64
import heapq
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.llm.common import by_chars, give_back, map_arrow, text_first, with_columns

#: Code points handled at once.
GROUP_CHARS = 1 << 17
#: Pieces that a worker remembers before it starts anew.
CACHE_PIECES = 250_000
#: Code points that are put into classes at once.
CLASS_POINTS = 1 << 14

LETTER, NUMBER, OTHER, QUOTE, QUOTE_1, QUOTE_2, SPACE_JOINS, BLANK_ALONE, BLANK_RUN, EDGE = range(10)
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, JOINING, IN_BLANKS, ONE_LEFT, TWO_LEFT = range(8)
#: What may follow a quotation mark in a contraction.
SHORT_ENDS, LONG_ENDS = "stmd", ("re", "ve", "ll")


def step(state: int, kind: int) -> tuple[int, bool]:
    """The state after a character of this class, and whether a piece starts at it."""
    if kind == EDGE:
        return FRESH, True
    if state == TWO_LEFT:
        return ONE_LEFT, False
    if state == ONE_LEFT:
        return FRESH, False
    if kind in (SPACE_JOINS, BLANK_ALONE):
        return (JOINING if kind == SPACE_JOINS else FRESH), True
    if kind == BLANK_RUN:
        return IN_BLANKS, state != IN_BLANKS
    run = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS}.get(kind, IN_OTHER)
    goes_on = state in (run, JOINING)
    if kind in (QUOTE_1, QUOTE_2) and not goes_on:
        return (ONE_LEFT if kind == QUOTE_1 else TWO_LEFT), True
    return run, not goes_on


@lru_cache(1)
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of each class's function; composition table; what each function makes of a state; boundaries."""
    identity = tuple(range(8))
    functions = {identity: 0}
    generators = []
    for kind in range(10):
        made = tuple(step(s, kind)[0] for s in range(8))
        functions.setdefault(made, len(functions))
        generators.append(made)
    todo = list(functions)
    while todo:
        first = todo.pop()
        for then in generators:
            both = tuple(then[s] for s in first)
            if both not in functions:
                functions[both] = len(functions)
                todo.append(both)
    order = sorted(functions, key=functions.get)
    compose = np.array([[functions[tuple(g[s] for s in f)] for g in order] for f in order], np.uint16)
    starts = np.array([[step(s, k)[1] for k in range(10)] for s in range(8)])
    return np.array([functions[g] for g in generators], np.uint16), compose, np.array(order, np.uint8), starts


@lru_cache(1)
def code_point_classes() -> np.ndarray:
    """The class of every code point, once for each worker.

    Which characters are letters, numbers or blanks changes with Unicode's versions, so the library whose
    ids are wanted says it: a pattern of the class alone picks its characters from all there are, some
    thousand at a time, as the library's answer takes many times the memory of what it is asked.
    """
    import tiktoken

    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK_RUN, r"\s")):
        library = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        for low in range(0, len(out), CLASS_POINTS):
            picked = library.encode_ordinary("".join(chr(c) for c in range(low, low + CLASS_POINTS) if not 0xD800 <= c < 0xE000))
            out[np.frombuffer(bytes(picked).decode().encode("utf-32-le"), np.uint32)] = kind
    return out


def classes(points: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """A class for each code point; what follows a blank or a quotation mark is part of it."""
    kinds = code_point_classes()[points]
    kinds[edges] = EDGE
    blank = kinds == BLANK_RUN
    text_next = np.zeros(len(kinds), bool)
    text_next[:-1] = ~blank[1:] & (kinds[1:] != EDGE)
    last = blank & text_next
    kinds[last] = np.where(points[last] == 32, SPACE_JOINS, BLANK_ALONE)
    quotes = np.flatnonzero((points == 39) & (kinds == OTHER))
    if len(quotes):
        ahead = np.zeros(len(points) + 2, np.uint32)
        ahead[: len(points)] = np.where(kinds == EDGE, 0, points)
        one, two = ahead[quotes + 1], ahead[quotes + 2]
        kinds[quotes] = QUOTE
        kinds[quotes[np.isin(one, [ord(c) for c in SHORT_ENDS])]] = QUOTE_1
        kinds[quotes[np.any([(one == ord(a)) & (two == ord(b)) for a, b in LONG_ENDS], axis=0)]] = QUOTE_2
    return kinds


def boundaries(points: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each code point; at `edges` stand separators between texts."""
    numbers, compose, apply, starts = automaton()
    kinds = classes(points, edges)
    n, m = len(kinds), len(compose)
    width = max(1, min(256, n))
    blocks = -(-n // width)
    padded = np.zeros(blocks * width, np.uint16)
    padded[:n] = numbers[kinds]
    scan = np.ascontiguousarray(padded.reshape(blocks, width).T)
    table = compose.ravel()
    for k in range(1, width):
        scan[k] = table[scan[k - 1].astype(np.intp) * m + scan[k]]
    total, gap = scan[-1].copy(), 1
    while gap < blocks:
        total[gap:] = table[total[:-gap].astype(np.intp) * m + total[gap:]]
        gap *= 2
    entry = np.full(blocks, FRESH, np.uint8)
    entry[1:] = apply[total[:-1], FRESH]
    before = np.empty((width, blocks), np.uint8)
    before[0] = entry
    before[1:] = apply.ravel()[scan[:-1].astype(np.intp) * 8 + entry]
    return starts[before.T.ravel()[:n], kinds]


class Merger:
    """Token ids of a piece of bytes, by merge ranks."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.cache: dict[bytes, bytes] = {}

    def piece(self, piece: bytes) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        found = self.cache.get(piece)
        if found is None:
            if len(self.cache) >= CACHE_PIECES:
                self.cache.clear()
            rank = self.ranks.get(piece)
            ids = (rank,) if rank is not None else self.merged(piece)
            found = struct.pack(f"<{len(ids)}I", *ids)
            if len(piece) <= 256:
                self.cache[piece] = found
        return found

    def merged(self, piece: bytes) -> tuple[int, ...]:
        """Merge the neighbours of lowest rank, leftmost first, until none has one."""
        n, ranks = len(piece), self.ranks
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        live = [True] * n
        heap = [(r, k, k + 2) for k in range(n - 1) if (r := ranks.get(piece[k : k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, stop = heapq.heappop(heap)
            middle = end[k]
            if not live[k] or middle >= n or end[middle] != stop or stop <= middle:
                continue
            live[middle], end[k] = False, stop
            if stop < n:
                before[stop] = k
                if (r := ranks.get(piece[k : end[stop]])) is not None:
                    heapq.heappush(heap, (r, k, end[stop]))
            if (p := before[k]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, k = [], 0
        while k < n:
            out.append(ranks[piece[k : end[k]]])
            k = end[k]
        return tuple(out)


@lru_cache(2)
def vocabulary(content: bytes) -> tuple[Merger, list[bytes]]:
    """From the lines `base64 rank` of a ranks file."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}
    by_id = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        by_id[rank] = token
    return Merger(ranks), by_id


def encode_texts(texts: list[str], content: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its ids and the byte at which each token starts."""
    merger = vocabulary(content)[0]
    sizes = token_sizes(content)
    joined = "\0".join(["", *texts, ""])
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    lengths = np.array([len(t) for t in texts], np.int64)
    edges = np.concatenate([[0], np.cumsum(lengths + 1)])
    at = np.flatnonzero(boundaries(points, edges))
    data = joined.encode()
    if len(data) == len(points):
        starts = at
    else:
        widths = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        starts = (np.cumsum(widths) - widths)[at]
    first = np.searchsorted(at, edges)
    cuts = starts.tolist()
    get, miss = merger.cache.get, merger.piece
    for k in range(len(texts)):
        lo, hi = int(first[k]) + 1, int(first[k + 1])
        pieces = [data[a:b] for a, b in zip(cuts[lo:hi], cuts[lo + 1 : hi + 1], strict=True)]
        found = list(map(get, pieces))
        if None in found:
            found = [f or miss(p) for f, p in zip(found, pieces, strict=True)]
        out = np.frombuffer(b"".join(found), "<u4")
        offsets = np.zeros(len(out), np.uint32)
        np.cumsum(sizes[out[:-1]], out=offsets[1:])
        yield out, offsets


@lru_cache(2)
def token_sizes(content: bytes) -> np.ndarray:
    return np.array([len(t) for t in vocabulary(content)[1]], np.uint32)


def read_ranks(path: str) -> bytes:
    """The ranks file, read where the driver runs; its size is fixed, so it goes out with the tasks."""
    with open(path, "rb") as f:
        return f.read()


def decode_ids(ids: np.ndarray, offsets: np.ndarray, content: bytes) -> bytes:
    """The tokens' bytes; each must start where its offset says."""
    if not np.array_equal(np.cumsum(token_sizes(content)[ids], dtype=np.int64)[:-1], offsets[1:]):
        raise ValueError("offsets do not belong to these ids")
    return b"".join(map(vocabulary(content)[1].__getitem__, ids.tolist()))


def encode(df: DataFrame, ranks_path: str, text: str = "text", keep: list[str] | None = None, with_bytes: bool = False, checked: bool = False) -> DataFrame:
    """The kept columns (all but the text unless named), ids and offsets, both as little-endian
    unsigned 32-bit integers, and n_tokens.

    with_bytes: decode each text's ids too, where they were made, and give the bytes in place of the
    offsets; the ids need not go through a second set of Python workers then.
    checked: give `intact` in place of the offsets, whether the decoded bytes are the text's; neither the
    text nor the bytes leave the worker then.
    """
    keep = [c for c in df.columns if c != text] if keep is None else keep
    second = "intact" if checked else "bytes" if with_bytes else "offsets"
    if clash := {"ids", second, "n_tokens"} & set(keep):
        raise ValueError(f"columns in the way: {sorted(clash)}")
    content = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    fields = [df.schema[c] for c in keep]
    schema = T.StructType([*fields, T.StructField("ids", T.BinaryType()), T.StructField(second, T.BooleanType() if checked else T.BinaryType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # what other stages have left in this worker
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            rest = batch.select(batch.schema.names[1:]).rename_columns(keep) if keep else None
            for a, b in by_chars(texts, GROUP_CHARS):
                pairs = list(encode_texts(texts[a:b], content.value))
                if checked:
                    more = pa.array([decode_ids(i, o, content.value) == t.encode() for (i, o), t in zip(pairs, texts[a:b], strict=True)], pa.bool_())
                else:
                    more = pa.array([decode_ids(i, o, content.value) if with_bytes else o.tobytes() for i, o in pairs], pa.binary())
                new = {"ids": pa.array([i.tobytes() for i, _ in pairs], pa.binary()), second: more, "n_tokens": pa.array([len(i) for i, _ in pairs], pa.int64())}
                yield with_columns(rest.slice(a, b - a), keep, **new) if keep else pa.RecordBatch.from_arrays(list(new.values()), names=list(new))
        give_back()

    return map_arrow(text_first(df, text, keep), run, schema)


def decode(df: DataFrame, ranks_path: str, keep: list[str] | None = None) -> DataFrame:
    """The kept columns and `bytes`, put together from ids and checked against their offsets."""
    keep = [c for c in df.columns if c not in ("ids", "offsets")] if keep is None else keep
    content = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("bytes", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = ((np.frombuffer(x.as_buffer() or b"", np.uint32) for x in p) for p in zip(batch.column(0), batch.column(1), strict=True))
            out = [decode_ids(ids, offsets, content.value) for ids, offsets in pairs]
            rest = batch.select(batch.schema.names[2:]).rename_columns(keep)
            yield with_columns(rest, keep, bytes=pa.array(out, pa.binary()))

    return map_arrow(df.select("ids", "offsets", *keep), run, schema)
