"""Near-duplicate classes by DartMinHash signatures and banded joins.

A text is its set of five-word shingles (or bag, weighted by counts). A shingle owns a strip of a plane
as wide as its weight; darts fall on the plane by hashing, the same for every text, at unit rate. A
text's signature keeps, of the darts that hit its strips, the earliest for each of its coordinates, so
two signatures agree in a coordinate with the probability of their weighted Jaccard similarity. Bands
of coordinates make the buckets.

Copies of one set are one node. Inside a bucket nodes are compared with leaders, not with each other:
first each node with its least leader, then, in rounds that go on while they find links, with a leader
drawn from each bucket that still holds several components (the one met in most buckets); and only what is
left after that pair by pair across components, inside tasks. Each comparison is of the whole sets. Nodes that are
linked already are not compared again, which loses no link between classes. Components come from min-label steps with pointer jumping.

Defined results: words are runs of non-blank characters, lower-cased; a text with fewer than five words
is one shingle; a text without words (or null) is a class of its own; documents are ordered by doc_id
(null first) and those of one doc_id by a hash of their text; the class id is the least doc_id of the
class; identical rows come back each; other columns pass through under any name but those of the new
ones, which raise ValueError; very long texts are read whole; a similarity of exactly the least counts.

With BANDS x ROWS = 40 x 6 a pair at similarity 0.8 shares no band with probability 5e-6.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.llm.common import free_names, give_back, map_arrow, smaller, stage, text_key

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 40, 6
#: Most rounds of leaders, and the share of a round's pairs that must be links for another one.
LEADER_ROUNDS, FRUITFUL = 8, 0.06
#: For pairs that no leader decided: coordinates of a byte each, the estimate from which a pair is compared
#: whole (4.5 standard deviations below the least similarity; None: every pair is), and nodes of a bucket
#: in a task's block. Bytes of whole sets that a task of the last comparison holds of each part.
SKETCH, DOUBT, BLOCK = 1024, 4.5, 4096
TASK_BYTES = 4 << 20
CACHE_WORDS = 100_000
#: Bytes of texts whose sets a worker holds at once; a longer text stands alone.
GROUP_BYTES = 2 << 20
NO_ID = -(1 << 63)

U = np.uint64
#: Odd multipliers of the mixing step and of the words in a shingle.
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)
STEPS = np.array([pow(0xD6E8FEB86659FD93, k, 1 << 64) for k in range(SHINGLE)], U)
#: Height of the lowest band of ranks; each band above doubles the height so far.
LOWEST = 1 / 64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(MIX[0])
    x = (x ^ (x >> U(29))) * U(MIX[1])
    return x ^ (x >> U(32))


def uniform(x: np.ndarray) -> np.ndarray:
    return (x >> U(11)).astype(np.float64) / (1 << 53)


def shingles(text: str, cache: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles, in order, and their counts."""
    words = text.lower().encode().split()
    if not words:
        return np.zeros(0, U), np.zeros(0, np.int64)
    if len(cache) > CACHE_WORDS:
        cache.clear()
    ids = list(map(cache.get, words))
    if None in ids:
        cache.update((w, xxhash.xxh3_64_intdigest(w)) for w, k in zip(words, ids, strict=True) if k is None)
        ids = list(map(cache.__getitem__, words))
    hashes = np.array(ids, U)
    n = max(len(words) - SHINGLE + 1, 1)
    total = np.zeros(n, U)
    for k in range(min(SHINGLE, len(words))):
        total += hashes[k : k + n] * STEPS[k]
    return np.unique(mix(total + U(len(words)) * U(len(words) < SHINGLE)), return_counts=True)


@lru_cache(64)
def poisson_steps(area: float) -> np.ndarray:
    """The cumulative probabilities of 0, 1, 2, ... darts on an area."""
    n = np.arange(int(area + 12 * np.sqrt(area) + 12))
    return np.cumsum(np.exp(n * np.log(area) - area - np.cumsum(np.log(np.maximum(n, 1)))))


def darts(elements: np.ndarray, weights: np.ndarray, heights: list[tuple[float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and rank of every dart with a rank in one of the ranges that hits an element's strip.

    Darts of a strip fall in cells one unit of weight wide: a Poisson number of them, by the cell's hash.
    """
    cells, owner, at = elements, weights, np.zeros(len(elements))
    if weights.max(initial=0) > 1:
        n = np.ceil(weights).astype(np.int64)
        row = np.repeat(np.arange(len(n)), n)
        at = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)).astype(np.float64)
        cells, owner = mix(elements[row] + at.astype(U)), weights[row]
    seed = mix(np.concatenate([cells ^ U(int(high / LOWEST)) for _, high in heights]))
    share = uniform(seed).reshape(len(heights), -1)
    count = np.concatenate([np.searchsorted(poisson_steps(high - low), s) for (low, high), s in zip(heights, share, strict=True)])
    row = np.repeat(np.arange(len(seed)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    dart = mix(seed[row] + nth.astype(U) * U(MIX[0]))
    which, cell = row // max(len(cells), 1), row % max(len(cells), 1)
    low, area = (np.array(v)[which] for v in ([h[0] for h in heights], [h[1] - h[0] for h in heights]))
    rank = low + area * uniform(mix(dart + U(2)))
    if len(cells) != len(elements) or (weights != 1).any():
        hit = at[cell] + uniform(mix(dart + U(1))) <= owner[cell]
        dart, rank = dart[hit], rank[hit]
    return dart, rank


def signature(elements: np.ndarray, weights: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """The earliest dart's hash for each coordinate."""
    best, rank = np.zeros(size, U), np.full(size, np.inf)
    enough = (size * np.log(size) + 2 * size) / max(weights.sum(), 1e-9)
    heights = [(0.0, LOWEST)]
    while heights[-1][1] < enough:
        heights.append((heights[-1][1], heights[-1][1] * 2))
    while True:
        dart, at = darts(elements, weights, heights)
        order = np.argsort(-at, kind="stable")  # the earliest of a coordinate is written last
        where, new = (dart[order] % U(size)).astype(np.int64), np.full(size, np.inf)
        found = np.zeros(size, U)
        found[where], new[where] = dart[order], at[order]
        earlier = new < rank
        best[earlier], rank[earlier] = found[earlier], new[earlier]
        if np.isfinite(rank).all():
            return best
        heights = [(heights[-1][1], heights[-1][1] * 2)]


def bands(sign: np.ndarray) -> np.ndarray:
    parts = mix(sign.reshape(BANDS, ROWS) + np.arange(ROWS, dtype=U) * U(MIX[1]))
    return mix(np.bitwise_xor.reduce(parts * np.arange(1, 2 * ROWS, 2, dtype=U), axis=1) + np.arange(BANDS, dtype=U))


def runs_of(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes; a larger row stands alone."""
    start = held = 0
    for k, n in enumerate(sizes.tolist()):
        if k > start and held + n > most:
            yield start, k
            start, held = k, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def sign_documents(df: DataFrame, weighted: bool) -> DataFrame:
    """at, id, tk of every row, and node (a digest of the set), bands and the set, null for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        give_back()  # what other stages have left in this worker
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(3)), 0).to_numpy(zero_copy_only=False)
            for start, end in runs_of(sizes, GROUP_BYTES):
                yield signed(batch.slice(start, end - start), cache)
        cache.clear()
        give_back()

    def signed(batch: pa.RecordBatch, cache: dict[bytes, int]) -> pa.RecordBatch:
        rows: list[tuple] = []
        known: dict[bytes, np.ndarray] = {}
        for text in batch.column(3):
            found, counts = shingles(text.as_py() or "", cache)
            if not len(found):
                rows.append((None, None, None))
                continue
            whole = packed(found, counts if weighted else np.ones(1, np.int64))
            node = hashlib.blake2b(whole, digest_size=16).digest()
            if node not in known:
                known[node] = bands(signature(found, counts.astype(float) if weighted else np.ones(len(found)))).view(np.int64)
            rows.append((node, known[node], whole))
        new = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.binary(), pa.list_(pa.int64()), pa.binary()))]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], *new], names=["at", "id", "tk", "node", "bands", "whole"])

    schema = T.StructType([*df.schema.fields[:3], *T._parse_datatype_string("node binary, bands array<long>, whole binary").fields])
    return map_arrow(df, run, schema)


def packed(found: np.ndarray, counts: np.ndarray) -> bytes:
    """A set's hashes, with their weights where one is above 1, and a mark that says so."""
    return found.tobytes() + (counts.astype(np.uint32).tobytes() + b"w" if counts.max() > 1 else b"s")


def stored(whole: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and weights of a stored set."""
    if whole[-1:] == b"s":
        x = np.frombuffer(whole, U, len(whole) // 8)
        return x, np.ones(len(x))
    n = len(whole) // 12
    return np.frombuffer(whole, U, n), np.frombuffer(whole, np.uint32, n, 8 * n).astype(float)


def similarity(a: bytes, b: bytes) -> float:
    (x, v), (y, w) = stored(a), stored(b)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = np.minimum(v[i], w[j]).sum()
    return float(both / (v.sum() + w.sum() - both))


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of nodes, from a staged table, whose sets are similar enough."""
    ends = smaller(pairs.select("a", "b", F.explode(F.array("a", "b")).alias("u")))
    both = sets.join(ends, "u").groupBy("a", "b").agg(F.max(F.when(F.col("u") == F.col("a"), F.col("whole"))).alias("x"), F.max(F.when(F.col("u") == F.col("b"), F.col("whole"))).alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similarity(x.as_py(), y.as_py()) >= least for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return stage(map_arrow(both, run, pairs.schema), "links")


def undecided(at: DataFrame, nodes: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between nodes of different components in one bucket, enough to join all that are linked.

    A bucket is cut into blocks, and every pair of blocks is looked at in a task of its own, so no task
    holds a bucket. Nodes whose sketches come near the least similarity, in the first band that they have in
    common, meet again with their whole sets in tasks cut by bytes. A task tells links of a forest only: no
    more rows than it has nodes, however many pairs it compares.
    """
    edge = 0.0 if DOUBT is None else least - DOUBT * np.sqrt(least * (1 - least) / SKETCH)
    size = at.groupBy("band", "value").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("u"), F.col("blocks")).cast("int")
    place = F.struct("band", "value", "blocks", own.alias("own"))
    # A node's sketch and set are joined once and then dealt to its tasks.
    rest = stage(at.join(size, ["band", "value"]).groupBy("u").agg(F.xxhash64(F.first("label")).alias("label"), F.collect_list(place).alias("places")), "rest")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for whole in batch.column(1):
                x, w = stored(whole.as_py())
                out.append((mix(signature(mix(x), w, SKETCH)) >> U(56)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["u", "sketch"])

    kind = rest.schema["u"].dataType.simpleString()
    sketches = map_arrow(sets.join(smaller(rest.select("u")), "u").dropDuplicates(["u"]).select("u", "whole"), sketch, f"u {kind}, sketch binary")
    told = rest.join(sketches, "u").join(nodes.select("u", "bands"), "u").select("u", "label", "sketch", "bands", F.explode("places").alias("p"))
    rows = told.select("u", "label", "sketch", "bands", "p.*", F.explode(F.sequence(F.lit(0), F.col("p.blocks") - 1)).alias("other"))
    rows = rows.select(F.xxhash64("band", "value", F.least("own", "other"), F.greatest("own", "other")).alias("task"), "band", (F.col("own") <= F.col("other")).alias("left"), (F.col("own") >= F.col("other")).alias("right"), "label", "u", "sketch", "bands")

    def alike(table: pa.Table) -> pa.Table:
        left, right = (np.flatnonzero(table[c].to_numpy(zero_copy_only=False)) for c in ("left", "right"))
        marks = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(-1, SKETCH)
        bands = np.array(table["bands"].to_pylist(), np.int64)
        label, band, both = table["label"].to_numpy(), table["band"][0].as_py(), np.isin(np.arange(table.num_rows), left)
        found, bits = np.zeros(len(label), bool), [b""] * len(label)
        for k in left:
            far = right[(label[right] != label[k]) & ((right > k) | ~both[right])]  # rows of one block meet once
            near = far[(marks[far] == marks[k]).mean(axis=1) >= edge]
            near = near[~(bands[near, :band] == bands[k, :band]).any(axis=1)]
            if len(near):
                found[near] = found[k] = True
                bits[k] = np.packbits(np.bincount(near).astype(bool), bitorder="little").tobytes()
        out = table.select(["task", "u", "label"]).append_column("k", pa.array(np.arange(len(label)), pa.int32())).append_column("near", pa.array(bits, pa.binary()))
        return out.filter(pa.array(found))

    near = rows.groupBy("task").applyInArrow(alike, f"task long, u {kind}, label long, k int, near binary")
    wanted = stage(near.groupBy("u").agg(F.first("label").alias("label"), F.collect_list(F.struct("task", "k", "near")).alias("tasks")), "wanted")
    whole = stage(sets.join(smaller(wanted), "u").dropDuplicates(["u"]).select("u", "label", "tasks", "whole"), "wholes")
    dealt = whole.select("u", "label", "whole", F.explode("tasks").alias("t")).select("u", "label", "whole", "t.*")
    parts = dealt.groupBy("task").agg(F.ceil(F.sum(F.octet_length("whole")) / TASK_BYTES).cast("int").alias("parts"))
    split = stage(parts.where("parts > 1"), "split")
    if not split.isEmpty():
        cut = dealt.join(smaller(split), "task", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        mine = F.pmod(F.xxhash64(F.lit("part"), "u"), F.col("parts")).cast("int")
        cut = cut.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        dealt = cut.select("u", "label", "whole", "k", "near", F.xxhash64("task", F.least("mine", "other"), F.greatest("mine", "other")).alias("task"))

    def compare(table: pa.Table) -> pa.Table:
        near = [np.flatnonzero(np.unpackbits(np.frombuffer(v.as_py(), np.uint8), bitorder="little")) for v in table["near"]]
        a, b = forest([w.as_py() for w in table["whole"]], table["label"].to_numpy(), table["k"].to_numpy(), near, least)
        u = table["u"].combine_chunks()
        return pa.table({"a": u.take(pa.array(a, pa.int64())), "b": u.take(pa.array(b, pa.int64()))})

    links = dealt.groupBy("task").applyInArrow(compare, f"a {kind}, b {kind}")
    return stage(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "links")


def forest(wholes: list[bytes], labels: np.ndarray, names: np.ndarray, near: list[np.ndarray], least: float) -> tuple[list[int], list[int]]:
    """Pairs of stored sets that are similar enough and join components (of the labels, and of the pairs so far).

    A set is compared with those that it is near to, by their names; the names may be of sets that are not here.
    """
    sets = [stored(w) for w in wholes]
    sizes, counts = np.array([v.sum() for _, v in sets]), np.array([len(x) for x, _ in sets])
    elements, weights = (np.concatenate(c) for c in zip(*sets, strict=True))
    starts = np.cumsum(counts) - counts
    where = np.full(max(int(names.max()), *(int(n.max(initial=0)) for n in near), 0) + 1, -1)
    where[names] = np.arange(len(sets))
    label = np.unique(labels, return_inverse=True)[1]
    a, b = [], []
    for k, (x, v) in enumerate(sets):
        j = where[near[k]]
        j = j[j >= 0]
        j = j[label[j] != label[k]]
        if not len(j):
            continue
        row = np.repeat(np.arange(len(j)), counts[j])
        at = np.arange(len(row)) + (starts[j] - np.cumsum(counts[j]) + counts[j])[row]
        place = np.minimum(np.searchsorted(x, elements[at]), len(x) - 1)
        both = np.bincount(row, np.where(x[place] == elements[at], np.minimum(v[place], weights[at]), 0.0), len(j))
        for i in j[both / (sizes[j] + sizes[k] - both) >= least]:
            if label[i] != label[k]:
                label[label == label[i]] = label[k]
                a.append(k)
                b.append(int(i))
    return a, b


def components(links: DataFrame) -> DataFrame:
    """u and its label, the least node linked to it, for every node of the links (a, b)."""
    edges = stage(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stage(edges.groupBy(F.col("a").alias("u")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = edges.join(labels, F.col("b") == F.col("u")).groupBy("a").agg(F.min("label").alias("least"))
        step = labels.join(near, F.col("u") == F.col("a")).select("u", F.col("label").alias("old"), F.least("label", "least").alias("label"))
        up = labels.select(F.col("u").alias("v"), F.col("label").alias("above"))
        now = stage(step.join(up, F.col("label") == F.col("v"), "left").select("u", "old", F.least("label", F.coalesce("above", "label")).alias("label")), "labels")
        if now.where(F.col("old") != F.col("label")).isEmpty():
            return now.select("u", "label")
        labels = now.select("u", "label")


def classed(signed: DataFrame, least: float) -> DataFrame:
    """id, tk and the class (its first document) of every row of signed documents, which is staged."""
    u = F.struct("id", "tk").alias("u")
    # A node is the first document of its set; its copies meet here and nowhere else.
    signed_words = signed.where(F.col("node").isNotNull())
    nodes = stage(signed_words.groupBy("node").agg(F.min(u).alias("u"), F.first("bands").alias("bands")), "nodes")
    sets = signed_words.select(u, "whole")
    members = nodes.select("u", F.posexplode("bands").alias("band", "value"))
    lead = members.groupBy("band", "value").agg(F.min("u").alias("a"), F.count("*").alias("n")).where(F.col("n") > 1)
    star = stage(members.join(lead, ["band", "value"]).select("band", "value", "a", F.col("u").alias("b")), "star")

    seen = stage(star.where("a != b").groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "pairs")
    links = verified(seen, sets, least)
    turn, fruitful = 0, True
    while True:
        labels = components(links)
        at = star.select("band", "value", F.col("b").alias("u")).join(labels, "u", "left").withColumn("label", F.coalesce("label", "u"))
        mixed = at.groupBy("band", "value").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("band", "value")
        at = stage(at.join(mixed, ["band", "value"]), "mixed")
        if at.isEmpty():  # every bucket holds one component: no pair is left
            break
        if turn >= LEADER_ROUNDS or not fruitful:
            labels = components(stage(links.unionByName(undecided(at, nodes, sets, least)), "links"))
            break
        # First a bucket's least node, then in each round another one of its first component. A node is
        # held against the leader that it meets in most buckets: the likeliest to be like it.
        order = F.struct("u") if not turn else F.struct("label", F.xxhash64(F.lit(turn), "u"), "u")
        leader = at.groupBy("band", "value").agg(F.min_by(F.struct("u", "label"), order).alias("l"))
        met = at.join(leader, ["band", "value"]).where(F.col("label") != F.col("l.label")).groupBy("u", F.col("l.u").alias("l")).agg(F.count("*").alias("n"))
        best = met.groupBy("u").agg(F.max_by("l", F.struct("n", "l")).alias("l"))
        pairs = best.select(F.least("u", "l").alias("a"), F.greatest("u", "l").alias("b")).distinct()
        pairs = stage(pairs.join(seen, ["a", "b"], "left_anti"), "pairs")
        compared = pairs.count()
        if compared:
            seen = seen.unionByName(pairs)
            new = verified(pairs, sets, least)
            fruitful = not turn or new.count() >= FRUITFUL * compared
            links = stage(links.unionByName(new), "links")
        else:
            fruitful = False
        turn += 1
    named = nodes.select("node", "u").join(smaller(labels), "u", "left").select("node", F.coalesce("label", "u").alias("class"))
    return signed.select("at", "id", "tk", "node").join(named, "node", "left").drop("node")


def signed_documents(df: DataFrame, text: str, keep: list[str], weighted: bool) -> DataFrame:
    """at (the kept columns), id, tk, node, bands and whole of every document, staged."""
    at = F.struct(*(F.col(c).alias(f"c{k}") for k, c in enumerate(keep))) if keep else F.struct(F.lit(1).alias("none"))
    rows = df.select(at.alias("at"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), text_key(F.col(text)).alias("tk"), F.col(text).cast("string").alias("text"))
    return stage(sign_documents(rows, weighted), "signed")


def classes(df: DataFrame, text: str = "text", keep: list[str] | None = None, least: float = SIMILARITY, weighted: bool = True) -> DataFrame:
    """The kept columns (doc_id by default), class_id and first (the class's first document, one row of it).

    The kept columns travel with the signatures; long ones are better joined afterwards.
    """
    keep = ["doc_id"] if keep is None else keep
    if clash := {"class_id", "first"} & set(keep):
        raise ValueError(f"columns in the way: {sorted(clash)}")
    out = classed(signed_documents(df, text, keep, weighted), least)
    first = F.col("class").isNull() | ((F.col("id") == F.col("class.id")) & (F.col("tk") == F.col("class.tk")))
    class_id = F.coalesce("class.id", "id")
    return out.select(*(F.col("at")[f"c{k}"].alias(c) for k, c in enumerate(keep)), F.when(class_id != NO_ID, class_id).alias("class_id"), first.alias("first"))


def representatives(df: DataFrame, text: str = "text", least: float = SIMILARITY, weighted: bool = True) -> DataFrame:
    """The rows of df that stand for their classes; of rows of one class with one doc_id and text one.

    Texts without words have no class and are told apart by all columns. Only keys are joined: texts
    stay where they are, but for those whose doc_id and text come twice.
    """
    found = stage(classed(signed_documents(df, text, [], weighted), least), "classes")
    gone = found.where((F.col("id") != F.col("class.id")) | (F.col("tk") != F.col("class.tk"))).select("id", "tk").distinct()
    twice = stage(found.groupBy("id", "tk").agg(F.count("*").alias("n"), F.max(F.col("class").isNotNull()).alias("has")).where("n > 1").select("id", "tk", "has"), "twice")
    i, k, row, has = free_names(df.columns, "_id", "_tk", "_row", "_has")
    keyed = df.withColumns({i: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), k: text_key(F.col(text))})
    stay = keyed.join(smaller(gone.select(F.col("id").alias(i), F.col("tk").alias(k))), [i, k], "left_anti")
    if twice.isEmpty():
        return stay.select(*df.columns)
    marked = stay.join(smaller(twice.select(F.col("id").alias(i), F.col("tk").alias(k), F.col("has").alias(has))), [i, k], "left")
    wordless = F.when(~F.col(has), F.struct(*df.columns))
    once = marked.where(F.col(has).isNotNull()).withColumn(row, wordless).dropDuplicates([i, k, row])
    return marked.where(F.col(has).isNull()).select(*df.columns).unionByName(once.select(*df.columns))
