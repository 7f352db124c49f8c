"""Removal of repeated substrings: every byte under a WIDTH-byte string that also starts earlier.

Every WIDTH-byte window is dealt to the least-hashed GRAM-byte string inside it, its anchor, so equal
windows always share an anchor at the same offset, and one anchor stands for a whole run of windows
(its span). Spans go to the partition of their anchor's hash:

1. equal spans: all but the first are repeats, whole. What an Arrow batch can tell by itself it tells
   before the shuffle, so a passage in every document costs a row for each batch.
2. different spans of one anchor: their bytes are fetched and suffix-sorted from the anchor on. The sort
   is a merge sort whose comparisons find the common extension of two suffixes by binary search over
   prefix polynomial hashes; neighbours' extensions are verified byte by byte. Windows are equal when
   their suffixes share enough after the anchor and their bytes before it are the same.
3. anchors in very many different spans. A sample of documents shows such anchors; a window takes one only
   when it holds no other gram, so few spans meet there. What still meets in numbers that one sort should
   not hold, known from the sample or not, is dealt by its windows.

The sample decides where rows go, not what is found. Polynomial hashes pick anchors and order suffixes;
they never decide equality alone: bytes are compared in case 2, and in cases 1 and 3, whose bytes lie in
different tasks, 128-bit BLAKE2b digests of the bytes are.

Defined results: texts are UTF-8 bytes, a null one is empty; documents are ordered by doc_id (a null one
first), those of one doc_id by a hash of their text, and identical rows are one document that comes
back for each; a text shorter than WIDTH keeps everything; an empty table gives an empty result; other
columns than doc_id and text are dropped, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.llm.common import flat, map_arrow, stage, text_key

WIDTH, GRAM = 100, 20
#: One document in so many is looked at for hot grams: those in HOT_IN_SAMPLE documents of the sample at
#: least that make up more than one in HOT_SHARE of all its grams; so there are no more than HOT_SHARE.
SAMPLED, HOT_IN_SAMPLE, HOT_SHARE = 256, 8, 1 << 16
GROUP_BYTES, PIECE_BYTES = 1 << 18, 1 << 20
#: Spans that are sorted at once, and spans whose windows are digested at once.
SORT_SPANS, WINDOW_SPANS = 16_000, 2_000
#: Bits of a look-up of hot anchors: the table is a first sieve, so that few grams are searched for.
SIEVE_BITS = 20

U = np.uint64
#: Odd base of the polynomial hashes and multipliers of the mixing step.
BASE = 0x5851F42D4C957F2D
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)
NO_ID = -(1 << 63)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(MIX[0])
    x = (x ^ (x >> U(29))) * U(MIX[1])
    return x ^ (x >> U(32))


class Powers:
    """Powers of a base and of its inverse modulo 2**64, as many as asked for."""

    def __init__(self, base: int) -> None:
        self.base, self.up, self.down = base, np.ones(1, U), np.ones(1, U)

    def reach(self, n: int) -> None:
        if len(self.up) <= n:
            for name, b in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                powers = np.full(n + n // 4 + 1, U(b))
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers, out=powers))


POWERS = Powers(BASE)


class Hashes:
    """Prefix polynomial hashes of a buffer: the hash of any slice in two look-ups."""

    def __init__(self, data: np.ndarray) -> None:
        self.powers = POWERS
        self.powers.reach(len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, U)
        np.cumsum((data.astype(U) + U(1)) * self.powers.down[: len(data)], out=self.prefix[1:])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * self.powers.up[start]


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    n, rows = len(v), -(-len(v) // width)
    padded = np.full(rows * width, U(0xFFFFFFFFFFFFFFFF))
    padded[:n] = v
    padded = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def pieces(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of (text number, offset in it, bytes). A long text is cut so that each window is in one piece."""
    group, size = [], 0
    for k, t in enumerate(texts):
        for at in range(0, max(len(t) - WIDTH + 1, 0), PIECE_BYTES):
            part = t[at : at + PIECE_BYTES + WIDTH - 1]
            if group and size + len(part) > GROUP_BYTES:
                yield group
                group, size = [], 0
            group.append((k, at, part))
            size += len(part)
    if group:
        yield group


class Hot:
    """The hashes of hot anchors: whether each of many hashes is one."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = np.sort(hashes)
        self.sieve = np.zeros(1 << SIEVE_BITS, bool)
        self.sieve[self.place(self.hashes)] = True

    @staticmethod
    def place(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> U(64 - SIEVE_BITS)).astype(np.int64)

    def among(self, hashes: np.ndarray) -> np.ndarray:
        """Indices of the hashes that are hot."""
        if not len(self.hashes):
            return np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.sieve[self.place(hashes)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        return maybe[self.hashes[at] == hashes[maybe]]


def digests_of(data: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of a 128-bit digest of each slice."""
    made = b"".join(blake2b(data[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True))
    both = np.frombuffer(made, U).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def anchors(texts: list[bytes], hot: Hot) -> dict[str, np.ndarray]:
    """Of every span: the text's number, anchor hash, digest, anchor position, first and last window start.

    Hot grams come after all others, whatever their hashes.
    """
    out: dict[str, list[np.ndarray]] = {c: [] for c in ("text", "h", "d1", "d2", "p", "s0", "s1")}
    for group in pieces(texts):
        whole = b"".join(g[2] for g in group)
        data = np.frombuffer(whole, np.uint8)
        ends = np.cumsum([len(g[2]) for g in group])
        one = Hashes(data)
        at = np.arange(len(data) - GRAM + 1)
        grams = mix(one.slices(at, at + GRAM))
        # The position in the low bits makes ties go left. 24 bits are enough for a group.
        key = grams >> U(1) & U(0x7FFFFFFFFF000000) | at.astype(U)
        key[hot.among(grams)] |= U(1 << 63)
        least = sliding_min(key, WIDTH - GRAM + 1)
        p, s = (least & U(0xFFFFFF)).astype(np.int64), at[: len(least)]
        piece = np.searchsorted(ends, s, side="right")
        inside = s + WIDTH <= ends[piece]
        p, s, piece = p[inside], s[inside], piece[inside]
        new = np.ones(len(s), bool)
        new[1:] = (p[1:] != p[:-1]) | (piece[1:] != piece[:-1])
        first = np.flatnonzero(new)
        s0, s1, p, piece = s[first], s[np.append(first[1:], len(s)) - 1], p[first], piece[first]
        begin = (ends - [len(g[2]) for g in group])[piece]
        offset = np.array([g[1] for g in group])[piece] - begin
        out["text"].append(np.array([g[0] for g in group])[piece])
        out["h"].append(grams[p])
        d1, d2 = digests_of(whole, s0, s1 + WIDTH)
        out["d1"].append(d1)
        out["d2"].append(d2)
        for c, v in (("p", p), ("s0", s0), ("s1", s1)):
            out[c].append(v + offset)
    return {c: flat(v, np.int64 if c not in ("h", "d1", "d2") else U) for c, v in out.items()}


def order_of(ids: np.ndarray, keys: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A number for each (id, key, start) in their order; equal ones get equal numbers."""
    order = np.lexsort((starts, keys, ids))
    same = np.ones(len(order), bool)
    same[:1] = False
    for c in (ids, keys, starts):
        same[1:] &= c[order][1:] == c[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(~same)
    return out


def first_of_group(keys: tuple[np.ndarray, ...], rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the index of the row of least rank in its group of equal keys; and a copy to keep."""
    order = np.lexsort((rank, *keys))
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[order][1:] != c[order][:-1] for c in keys], axis=0)
    heads = order[np.flatnonzero(new)]
    first = np.empty(len(order), np.int64)
    first[order] = heads[np.cumsum(new) - 1]
    return first, heads


def suffix_order(hashes: Hashes, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Suffixes data[start : start + length] in order: a merge sort, all runs of a level at once.

    An element's place in a merged run is its own place plus the number of elements of the sister run
    below it, found by binary search; equal suffixes keep the left run first.
    """
    n = len(start)
    order = np.arange(n)
    width = 1
    while width < n:
        place = np.arange(n)
        block = place // width
        right = block % 2 == 1
        lo = np.where(right, (block - 1) * width, np.minimum((block + 1) * width, n))
        base, hi = lo.copy(), np.minimum(lo + width, n)
        live = np.flatnonzero(lo < hi)
        while len(live):
            middle = (lo[live] + hi[live]) // 2
            sign = compare(hashes, data, start, length, order[middle], order[live])
            below = (sign < 0) | ((sign == 0) & right[live])
            lo[live[below]] = middle[below] + 1
            hi[live[~below]] = middle[~below]
            live = live[lo[live] < hi[live]]
        to = place + (lo - base) - np.where(right, width, 0)
        merged = np.empty_like(order)
        merged[to] = order
        order, width = merged, width * 2
    return order


def extension(hashes: Hashes, start: np.ndarray, length: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common extension of suffixes a and b, by binary search over their hashes."""
    lo, hi = np.zeros(len(a), np.int64), np.minimum(length[a], length[b])
    while (lo < hi).any():
        middle = (lo + hi + 1) // 2
        equal = hashes.slices(start[a], start[a] + middle) == hashes.slices(start[b], start[b] + middle)
        lo, hi = np.where(equal, middle, lo), np.where(equal, hi, middle - 1)
    return lo


def compare(hashes: Hashes, data: np.ndarray, start: np.ndarray, length: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    same = extension(hashes, start, length, a, b)
    end_a, end_b = same == length[a], same == length[b]
    byte = lambda x, end: np.where(end, -1, data[np.minimum(start[x] + same, len(data) - 1)].astype(np.int64))
    return np.sign(byte(a, end_a) - byte(b, end_b))


def equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether data[a : a + n] and data[b : b + n] are the same, row by row."""
    steps, last, out = np.arange(int(n.max(initial=0))), len(data) - 1, np.ones(len(a), bool)
    for k in range(0, len(a), 4096):
        rows = slice(k, k + 4096)
        same = data[np.minimum(a[rows, None] + steps, last)] == data[np.minimum(b[rows, None] + steps, last)]
        out[rows] = (same | (steps >= n[rows, None])).all(axis=1)
    return out


def repeated_windows(spans: list[bytes], left: np.ndarray, lowest: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For spans with their anchors at `left`: the most and the fewest bytes before the anchor at which a
    window starts that also starts at a span of lower rank; -1 where there is none.

    lowest: the fewest bytes before the anchor of any window of the span; left is the most.
    """
    sizes = np.array([len(s) for s in spans])
    data = np.frombuffer(b"".join(spans), np.uint8)
    begin = np.cumsum(sizes) - sizes
    start, length = begin + left, sizes - left
    hashes = Hashes(data)
    order = suffix_order(hashes, data, start, length)
    common = extension(hashes, start, length, order[1:], order[:-1])
    wrong = ~equal_bytes(data, start[order[1:]], start[order[:-1]], common)
    for k in np.flatnonzero(wrong):  # hashes that collided
        a, b = (data[start[x] : start[x] + common[k]] for x in (order[k + 1], order[k]))
        common[k] = int(np.argmin(a == b))
    most, fewest = np.full(len(spans), -1), np.full(len(spans), -1)
    for before in range(WIDTH - GRAM, -1, -1):
        live = np.flatnonzero((lowest <= before) & (before <= left))
        if len(live) < 2:
            continue
        classes = np.empty(len(spans), np.int64)
        classes[order] = np.concatenate([[0], np.cumsum(common < WIDTH - before)])
        head = hashes.slices(start[live] - before, start[live])
        first, _ = first_of_group((head, classes[live]), rank[live])
        later = np.flatnonzero(rank[live] > rank[live][first])
        a, b = live[later], live[first[later]]
        same = equal_bytes(data, start[a] - before, start[b] - before, np.full(len(a), before)) if len(a) else np.zeros(0, bool)
        if not same.all():
            a = np.append(a[same], slow_repeats(data, start, classes, rank, live, before, a[~same]))
        most[a] = np.maximum(most[a], before)
        fewest[a] = before
    return most, fewest


def slow_repeats(data: np.ndarray, start: np.ndarray, classes: np.ndarray, rank: np.ndarray, live: np.ndarray, before: int, doubtful: np.ndarray) -> np.ndarray:
    """Of rows whose left hash collided with another's, those that do repeat an earlier row's bytes."""
    out = []
    for a in doubtful:
        for b in live[(classes[live] == classes[a]) & (rank[live] < rank[a])]:
            if np.array_equal(data[start[a] - before : start[a]], data[start[b] - before : start[b]]):
                out.append(a)
                break
    return np.array(out, np.int64)


def columns(**c: np.ndarray) -> pa.RecordBatch:
    kind = {np.dtype(U): np.int64}
    return pa.RecordBatch.from_arrays([pa.array(v.view(kind.get(v.dtype, v.dtype))) for v in c.values()], names=list(c))


def find_spans(batches: Iterator[pa.RecordBatch], hot: Hot) -> Iterator[pa.RecordBatch]:
    """Spans of (did, tk, bytes); done: the batch alone shows that an earlier one is equal."""
    for batch in batches:
        found = anchors(batch.column(2).to_pylist(), hot)
        ids, keys = (batch.column(c).to_numpy()[found["text"]] for c in (0, 1))
        if not len(ids):
            continue
        rank = order_of(ids, keys, found["s0"])
        first, heads = first_of_group((found["d2"], found["d1"]), rank)
        done = rank > rank[first]
        keep = done.copy()
        keep[heads] = True
        heat = np.zeros(len(ids), bool)
        heat[hot.among(found["h"])] = True
        rows = {"h": found["h"], "d1": found["d1"], "d2": found["d2"], "did": ids, "tk": keys, "s0": found["s0"], "shape": packed(found["p"] - found["s0"], found["s1"] - found["s0"], heat, done)}
        yield columns(**{c: v[keep] for c, v in rows.items()})


def packed(before: np.ndarray, more: np.ndarray, hot: np.ndarray, done: np.ndarray) -> np.ndarray:
    """Where the anchor and the last window lie, counted from the first window, and two marks, in one small
    number: a shuffled row is mostly hashes, and all else in it should cost next to nothing."""
    return (before << 9 | more << 2 | hot.astype(np.int64) << 1 | done).astype(np.int32)


SPANS = "h long, d1 long, d2 long, did long, tk long, s0 long, shape int"


def unpacked() -> dict[str, Column]:
    shape, s0 = F.col("shape"), F.col("s0")
    bit = lambda k: shape.bitwiseAND(F.lit(k)) == k
    return {"p": s0 + F.shiftright(shape, 9), "s1": s0 + F.shiftright(shape, 2).bitwiseAND(F.lit(127)), "hot": bit(2), "done": bit(1)}


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h of each different gram of each text of (bytes)."""
    for batch in batches:
        for group in pieces(batch.column(0).to_pylist()):
            for _, _, part in group:
                one, at = Hashes(np.frombuffer(part, np.uint8)), np.arange(len(part) - GRAM + 1)
                yield columns(h=np.unique(mix(one.slices(at, at + GRAM))))


def cut_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each wanted span of (did, tk, bytes, wanted)."""
    for batch in batches:
        out: dict[str, list] = {c: [] for c in ("h", "hot", "did", "tk", "p", "s0", "s1", "span")}
        for did, tk, data, wanted in zip(*(batch.column(c) for c in range(4)), strict=True):
            data = data.as_py()
            for w in wanted.as_py():
                for c, v in (w | {"did": did.as_py(), "tk": tk.as_py(), "span": data[w["s0"] : w["s1"] + WIDTH]}).items():
                    out[c].append(v)
            if len(out["h"]) > 5_000:
                yield pa.RecordBatch.from_pydict(out, schema=CUT_ARROW)
                out = {c: [] for c in out}
        yield pa.RecordBatch.from_pydict(out, schema=CUT_ARROW)


CUT = "h long, hot boolean, did long, tk long, p long, s0 long, s1 long, span binary"
CUT_ARROW = pa.schema([("h", pa.int64()), ("hot", pa.bool_()), ("did", pa.int64()), ("tk", pa.int64()), ("p", pa.int64()), ("s0", pa.int64()), ("s1", pa.int64()), ("span", pa.binary())])


FOUND = "did long, tk long, start long, end long, w1 long, w2 long"


def found_rows(did: np.ndarray, tk: np.ndarray, start: np.ndarray, end: np.ndarray, w1: np.ndarray | None = None, w2: np.ndarray | None = None) -> pa.RecordBatch:
    """Repeats, or windows with their digests that may be."""
    none = pa.nulls(len(did), pa.int64())
    digest = [none if w is None else pa.array(w.view(np.int64)) for w in (w1, w2)]
    return pa.RecordBatch.from_arrays([*(pa.array(v) for v in (did, tk, start, end)), *digest], names=["did", "tk", "start", "end", "w1", "w2"])


def sort_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats among spans that arrive in the order of their anchors' hashes.

    An anchor that alone has more than SORT_SPANS spans gives its windows, so no more than twice that
    many spans are held.
    """
    held: list[pa.RecordBatch] = []
    over: int | None = None

    def found(table: pa.Table) -> pa.RecordBatch:
        did, tk, p, s0, s1 = (table[c].to_numpy() for c in ("did", "tk", "p", "s0", "s1"))
        most, fewest = repeated_windows(table["span"].to_pylist(), p - s0, p - s1, order_of(did, tk, p))
        hit = most >= 0
        return found_rows(did[hit], tk[hit], (p - most)[hit], (p - fewest + WIDTH)[hit])

    for batch in batches:
        h = batch.column(0).to_numpy()
        if over is not None:
            more = int(np.searchsorted(h, over, side="right"))
            yield from cut_windows(iter([batch.slice(0, more)]))
            batch, h = batch.slice(more), h[more:]
            if not len(h):
                continue
            over = None
        held.append(batch)
        if sum(b.num_rows for b in held) >= SORT_SPANS:
            table = pa.Table.from_batches(held)
            h = table["h"].to_numpy()
            cut = int(np.searchsorted(h, h[-1]))  # the last anchor may go on
            if cut:
                yield found(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
            if len(h) - cut >= SORT_SPANS:
                over = int(h[-1])
                yield from cut_windows(iter(held))
                held = []
    if held and sum(b.num_rows for b in held):
        yield found(pa.Table.from_batches(held))


def runs_of(did: np.ndarray, tk: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """did, tk, start and end of the runs of bytes under windows that start at each place."""
    order = np.lexsort((start, tk, did))
    did, tk, start = did[order], tk[order], start[order]
    new = np.ones(len(start), bool)
    new[1:] = (did[1:] != did[:-1]) | (tk[1:] != tk[:-1]) | (start[1:] > start[:-1] + WIDTH)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1 if len(start) else first
    return did[first], tk[first], start[first], start[last] + WIDTH


def cut_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of the spans with their digests; those that repeat an earlier one of the batch, as runs."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        for lo in range(0, len(table), WINDOW_SPANS):
            part = table.slice(lo, WINDOW_SPANS)
            spans = part["span"].to_pylist()
            did, tk, s0, s1 = (part[c].to_numpy() for c in ("did", "tk", "s0", "s1"))
            begin = np.cumsum([len(s) for s in spans]) - [len(s) for s in spans]
            n = s1 - s0 + 1
            row = np.repeat(np.arange(len(spans)), n)
            step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            at = begin[row] + step
            w1, w2 = digests_of(b"".join(spans), at, at + WIDTH)
            did, tk, start = did[row], tk[row], s0[row] + step
            rank = order_of(did, tk, start)
            first, heads = first_of_group((w2, w1), rank)
            done = rank > rank[first]
            yield found_rows(*runs_of(did[done], tk[done], start[done]))
            yield found_rows(did[heads], tk[heads], start[heads], start[heads] + WIDTH, w1[heads], w2[heads])


def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text of (doc_id, bytes, repeats)."""
    for batch in batches:
        out: dict[str, list] = {c: [] for c in ("kept", "n_bytes", "n_removed", "spans")}
        for data, repeats in zip(batch.column(1), batch.column(2), strict=True):
            data, runs = data.as_py(), []
            for r in sorted((r["start"], r["end"]) for r in repeats.as_py() or []):
                if runs and r[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], r[1])
                else:
                    runs.append(list(r))
            cuts = [0, *(x for r in runs for x in r), len(data)]
            out["kept"].append(b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)))
            out["n_bytes"].append(len(data))
            out["n_removed"].append(sum(b - a for a, b in runs))
            out["spans"].append([{"start": a, "end": b} for a, b in runs])
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        kinds = {"kept": pa.binary(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "spans": span}
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[c], k) for c, k in kinds.items())], names=["doc_id", *kinds])


def hot_grams(documents: DataFrame) -> np.ndarray:
    """Hashes of the grams in many documents of the sample: where rows go, not what is found."""
    sample = documents.where(F.pmod(F.xxhash64("did", "tk"), F.lit(SAMPLED)) == 0).select("bytes")
    grams = stage(map_arrow(sample, count_grams, "h long").groupBy("h").agg(F.count("*").alias("n")), "grams")
    total = grams.agg(F.sum("n")).first()[0] or 0
    # At most HOT_SHARE rows: each has more than that share of them all.
    hot = grams.where(F.col("n") >= max(HOT_IN_SAMPLE, total / HOT_SHARE)).select("h").toArrow()
    return hot["h"].to_numpy().view(U)


def find_repeats(documents: DataFrame) -> DataFrame:
    """Runs (did, tk, start, end) of repeated bytes of documents (did, tk, bytes), some overlapping."""
    hot = documents.sparkSession.sparkContext.broadcast(hot_grams(documents))
    spans = map_arrow(documents, lambda batches: find_spans(batches, Hot(hot.value)), SPANS)
    # A span that is done needs no group any more; a hot anchor's spans only meet their equals.
    shape = unpacked()
    to = F.when(shape["done"], F.xxhash64("did", "s0")).when(shape["hot"], F.col("d1")).otherwise(F.col("h"))
    equal, near = Window.partitionBy("to", "h", "d1", "d2", "done").orderBy("did", "tk", "s0"), Window.partitionBy("to")
    ranked = spans.repartition(to).withColumns({"to": to, "done": shape["done"]}).withColumn("first", F.rank().over(equal) == 1)
    ranked = ranked.withColumn("others", F.min("d1").over(near) != F.max("d1").over(near))
    repeat = F.col("done") | ~F.col("first")
    told = stage(ranked.withColumns(shape).where(repeat | F.col("others") | F.col("hot")).select(F.when(~repeat, F.col("h")).alias("h"), "hot", "did", "tk", "p", "s0", "s1", repeat.alias("repeat")), "spans")
    wanted = told.where(~F.col("repeat")).groupBy("did", "tk").agg(F.collect_set(F.struct("h", "hot", "p", "s0", "s1")).alias("wanted"))
    cut = stage(map_arrow(documents.join(wanted, ["did", "tk"]).select("did", "tk", "bytes", "wanted"), cut_spans, CUT), "cut")
    by_sort = map_arrow(cut.where(~F.col("hot")).repartition("h").sortWithinPartitions("h"), sort_spans, FOUND)
    by_window = map_arrow(cut.where("hot"), cut_windows, FOUND)
    found = stage(by_sort.unionByName(by_window), "found")
    earlier = F.rank().over(Window.partitionBy("w1", "w2").orderBy("did", "tk", "start"))
    windows = found.where(F.col("w1").isNotNull()).withColumn("r", earlier).where("r > 1")
    whole = told.where("repeat").select("did", "tk", F.col("s0").alias("start"), (F.col("s1") + WIDTH).alias("end"))
    return whole.unionByName(found.where(F.col("w1").isNull()).select(*whole.columns)).unionByName(windows.select(*whole.columns))


def remove_repeats(df: DataFrame, text: str = "text") -> DataFrame:
    """Of each document doc_id, kept (bytes), n_bytes, n_removed and spans (the maximal runs removed)."""
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    whole = df.select(F.col("doc_id").cast("long").alias("doc_id"), did.alias("did"), text_key(F.col(text)).alias("tk"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("bytes"))
    repeats = find_repeats(whole.select("did", "tk", "bytes")).groupBy("did", "tk").agg(F.collect_set(F.struct("start", "end")).alias("repeats"))
    joined = whole.join(repeats, ["did", "tk"], "left").select("doc_id", "bytes", "repeats")
    return map_arrow(joined, remove, "doc_id long, kept binary, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>")


def digests(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
