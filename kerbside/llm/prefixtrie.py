"""The prefix trie of conversations, from mergeable partial tries.

A node is a distinct sequence of first turns. It is known by its depth and a polynomial hash of its turns
modulo 2^127 - 1; such hashes of pieces can be joined, so a conversation of any length is read in pieces by
many tasks, and the hash of a prefix is had from where its piece starts.

1. Turns are dealt out by ranges of (conversation, turn). Each task numbers and hashes what it holds; one
   row for each piece says what came before it. First turns of other conversations (`rebuild`) are put in by
   arithmetic on these hashes.
2. Every conversation meets every node on its path (a table of steps). Tasks combine their steps into a node
   table, and tables are merged by node twice, first MERGED tasks' at a time: members and ends add up, the
   smallest member stays. So a node that all conversations share costs a row a task.
   End lists merge as sorted chunks of ids that are read through a digest, never gathered.
3. The rollup takes no job for each level, as one conversation may make as many levels as it has turns. A
   conversation is the smallest member from some depth on, down to its end; up to there its turns are saved
   by smaller ones. So from the leaf up, each step of a conversation adds the words from here to that depth,
   and one leaf if it is the smallest member of a leaf; sums of these by node are sums over the subtree.

Defined results: a null turn comes first; turns of one number are ordered by the SHA-256 of role and text, and
repeated rows are turns each; a null role or text is an empty one; rows without a conversation id are left
out; an empty table has no nodes; other columns are dropped. Texts are hashed where they are read and go no
further. Hot conversations are split by range, hot nodes combined before they are dealt, and parents of very
many children (the HOT_PARENTS of the most) sent to their children's tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import map_arrow, stage

PRIME = (1 << 127) - 1
BASE = int.from_bytes(sha256(b"conversation prefixes").digest()[:15], "big")
#: Parents that are broadcast, by most children; ids in a chunk of an end list.
HOT_PARENTS, CHUNK = 4096, 4096
#: Tasks' node tables that the first merge takes together.
MERGED = 32
#: Turns that a rebuilt conversation takes from another at most, and how many ids share one source.
HEADS, GROUP = 3, 20
ROOT = bytes(24)


def pack(x: int) -> bytes:
    return x.to_bytes(16, "big")


def number(x: bytes) -> int:
    return int.from_bytes(x, "big")


def node(depth: int, code: int) -> bytes:
    """A node's name; names sort by depth."""
    return depth.to_bytes(8, "big") + pack(code)


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns), strict=True)


def batches_of(rows: Iterator[tuple], schema: pa.Schema, most: int = 4096) -> Iterator[pa.RecordBatch]:
    some = []
    for r in rows:
        some.append(r)
        if len(some) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)
            some = []
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


def arrow_rows(df: DataFrame, run, ddl: str) -> DataFrame:  # noqa: ANN001
    """mapInArrow of a function from all rows of a task (as tuples) to rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_of(run(r for b in batches for r in rows_of(b)), schema)

    return map_arrow(df, each, ddl)


def number_turns(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Of a task's sorted turns, each one's number, hash and words before it within the piece."""
    part = TaskContext.get().partitionId()
    now, i, code, power, words = None, 0, 0, 1, 0
    for c, digest, w in rows:
        if c != now:
            now, i, code, power, words = c, 0, 0, 1, 0
        i += 1
        term = number(digest) * power % PRIME
        yield c, part, i, pack(code), pack(term), w, words
        code, power, words = (code + term) % PRIME, power * BASE % PRIME, words + w


def join_pieces(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Of pieces sorted by conversation and part, what lies before each: turns, hash, words."""
    now, n, code, words = None, 0, 0, 0
    for c, part, size, before, term, w in rows:
        if c != now:
            now, n, code, words = c, 0, 0, 0
        yield c, part, n, pack(code), words, size, w, pack(after := (code + (number(before) + number(term)) * pow(BASE, n, PRIME)) % PRIME)
        n, code, words = n + size, after, words + w


def first_turns(heads: list[dict] | None) -> list[tuple[int, int]]:
    """(digest, words) of a conversation's first turns; each knows its place in its piece."""
    found = sorted(heads or [], key=lambda t: t["r"])
    return [(number(t["term"]) * pow(BASE, 1 - t["i"], PRIME) % PRIME, t["w"]) for t in found]


def plan_paths(rows: Iterator[tuple]) -> Iterator[tuple]:
    """How each conversation is rebuilt, and its steps over the turns of another."""
    for c, taken, size, words, total, own, source in rows:
        mine, theirs = first_turns(own), first_turns(source)[:taken]
        code = spoken = depth = 0
        steps = [(ROOT, None, 0, 0)]
        for v, w in theirs:
            after = (code + v * pow(BASE, depth, PRIME)) % PRIME
            steps.append((node(depth + 1, after), node(depth, code), w, spoken))
            code, spoken, depth = after, spoken + w, depth + 1
        skipped = said = 0
        for k, (v, w) in enumerate(mine[:taken]):
            skipped, said = (skipped + v * pow(BASE, k, PRIME)) % PRIME, said + w
        shift = depth - taken
        scale = pow(BASE, shift, PRIME)
        base = (code - scale * skipped) % PRIME
        end = depth + max(0, size - taken)
        last = node(end, (base + scale * number(total)) % PRIME if size > taken else code)
        yield c, taken, shift, pack(scale), pack(base), spoken - said, end, spoken + words - said, last, steps


def own_steps(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Steps over a conversation's own turns: a turn's number and hash in its piece, and the piece's place."""
    at = None
    for c, part, i, before, term, w, said, n, code, spoken, taken, shift, scale, base, behind, end in rows:
        if n + i <= taken:
            continue
        if at != (c, part):
            at, by = (c, part), number(scale)
            start, times = (number(base) + by * number(code)) % PRIME, by * pow(BASE, n, PRIME) % PRIME
        parent = (start + times * number(before)) % PRIME
        depth = n + i + shift
        yield c, part, depth, node(depth, (parent + times * number(term)) % PRIME), node(depth - 1, parent), w, behind + spoken + said, depth == end


STEPS = "c long, part int, depth long, node binary, parent binary, w long, before long, ends boolean"


def join_ids(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Sorted (node, id) to chunks of ids."""
    now, ids = None, []
    for name, c in rows:
        if ids and (name != now or len(ids) >= CHUNK):
            yield now, ids[0], ",".join(map(str, ids))
            ids = []
        now = name
        ids.append(c)
    if ids:
        yield now, ids[0], ",".join(map(str, ids))


def digest_ids(rows: Iterator[tuple]) -> Iterator[tuple]:
    """A node's chunks, sorted, to the SHA-256 of all its ids."""
    now, digest = None, None
    for name, _, ids in rows:
        if name != now:
            if digest:
                yield now, digest.hexdigest()
            now, digest = name, sha256(ids.encode())
        else:
            digest.update(b"," + ids.encode())
    if digest:
        yield now, digest.hexdigest()


def merge(steps: DataFrame, *measures: tuple[Column, Column]) -> DataFrame:
    """Measures by node: tasks combine their own rows, and then two merges by node. A measure comes as what
    it is of rows, and of partial results."""
    bins = (F.spark_partition_id() / F.lit(MERGED)).cast("int")
    some = steps.withColumn("bin", bins).groupBy("node", "bin").agg(*(a for a, _ in measures))
    return some.groupBy("node").agg(*(b for _, b in measures))


def total(value: Column | str, name: str) -> tuple[Column, Column]:
    return F.sum(value).alias(name), F.sum(name).alias(name)


def trie(conversations: DataFrame, rebuild: bool = True, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    With rebuild, the first h turns of conversation c are replaced by those of conversation c - c % GROUP,
    where h is the CRC-32 of the decimal c, modulo HEADS + 1.
    """
    spark = conversations.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    said = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(said(role)).cast("string"), F.lit(":"), said(role), said(text)), 256), 1, 32))
    turns = conversations.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("c"), F.col(turn).alias("turn"), digest.alias("v"), F.regexp_count(said(text), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("w"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("c"), F.col("turn").asc_nulls_first(), F.col("v"), F.col("row")]
    dealt = turns.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("c", "v", "w")
    placed = stage(arrow_rows(dealt, number_turns, "c long, part int, i long, code binary, term binary, w long, said long"), "turns")

    pieces = placed.groupBy("c", "part").agg(F.max("i").alias("n"), F.max_by(F.struct("code", "term"), "i").alias("x"), F.sum("w").alias("w")).select("c", "part", "n", "x.code", "x.term", "w")
    pieces = stage(arrow_rows(pieces.repartition(parts, "c").sortWithinPartitions("c", "part"), join_pieces, "c long, part int, n0 long, code0 binary, said0 long, n long, w long, after binary"), "pieces")

    heads = placed.where(F.col("i") <= HEADS).select("c", "part", "i", "term", "w").join(pieces.where(F.col("n0") < HEADS).select("c", "part", "n0"), ["c", "part"])
    heads = heads.withColumn("r", F.col("n0") + F.col("i")).where(F.col("r") <= HEADS).groupBy("c").agg(F.collect_list(F.struct("r", "i", "term", "w")).alias("own"))
    known = pieces.groupBy("c").agg(F.sum("n").alias("size"), F.sum("w").alias("words"), F.max_by("after", "part").alias("total")).join(heads, "c")
    if rebuild:
        known = stage(known, "heads")
        sources = known.where(F.col("c") % GROUP == 0).select(F.col("c").alias("source"), F.col("own").alias("first"))
        known = known.withColumn("source", F.col("c") - F.col("c") % GROUP).join(sources, "source", "left").withColumn("taken", F.crc32(F.col("c").cast("string")) % (HEADS + 1))
    else:
        known = known.withColumn("first", F.col("own")).withColumn("taken", F.lit(0).cast("long"))
    steps_type = "array<struct<node: binary, parent: binary, w: long, before: long>>"
    paths = stage(arrow_rows(known.select("c", "taken", "size", "words", "total", "own", "first"), plan_paths, f"c long, taken long, shift long, scale binary, base binary, behind long, end long, words long, last binary, steps {steps_type}"), "paths")

    places = pieces.select("c", "part", "n0", "code0", "said0").join(paths.select("c", "taken", "shift", "scale", "base", "behind", "end"), "c")
    own = arrow_rows(placed.join(places, ["c", "part"]).select("c", "part", "i", "code", "term", "w", "said", "n0", "code0", "said0", "taken", "shift", "scale", "base", "behind", "end"), own_steps, STEPS)
    taken = paths.select("c", F.lit(-1).alias("part"), F.posexplode("steps").alias("depth", "s"), "end").select("c", "part", F.col("depth").cast("long").alias("depth"), "s.node", "s.parent", "s.w", "s.before", (F.col("depth") == F.col("end")).alias("ends"))
    steps = stage(own.unionByName(taken), "steps")

    one = lambda name: (F.min(name).alias(name), F.min(name).alias(name))
    nodes = stage(merge(steps, (F.min("c").alias("conv_id"), F.min("conv_id").alias("conv_id")), one("depth"), one("parent"), one("w"), total(F.lit(1).cast("long"), "n_convs"), total(F.col("ends").cast("long"), "n_ends")), "nodes")

    # What each conversation saves and ends, sent to its pieces and from there to its steps.
    first = nodes.groupBy(F.col("conv_id").alias("c")).agg(F.sum("w").alias("new"), F.max(F.col("n_ends") == F.col("n_convs")).alias("leaf"))
    ups = paths.select("c", "words").join(first, "c", "left").select("c", (F.col("words") - F.coalesce("new", F.lit(0))).alias("old"), F.coalesce("leaf", F.lit(False)).cast("long").alias("leaf")).where((F.col("old") > 0) | (F.col("leaf") > 0))
    homes = pieces.select("c", "part").join(ups, "c").unionByName(ups.withColumn("part", F.lit(-1)))
    risen = steps.select("c", "part", "node", "before").join(homes, ["c", "part"])
    rolled = merge(risen, total("leaf", "n_leaves"), total(F.greatest(F.lit(0).cast("long"), F.col("old") - F.col("before")), "saved_tokens"))

    ended = paths.select(F.col("last").alias("node"), "c").repartitionByRange(parts, "node", "c").sortWithinPartitions("node", "c")
    chunks = arrow_rows(ended, join_ids, "node binary, first long, ids string").repartition(parts, "node").sortWithinPartitions("node", "first")
    digests = arrow_rows(chunks, digest_ids, "node binary, ends_sha256 string")

    children = stage(nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children")), "children")
    hot = F.broadcast(children.orderBy(F.desc("n_children"), "node").limit(HOT_PARENTS).select("node").join(nodes.select("node", "conv_id"), "node").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")))
    slim = nodes.select("node", "conv_id", "depth", "parent", "n_convs")
    near = slim.join(hot, "parent", "left")
    far = near.where(F.col("parent_conv_id").isNull()).drop("parent_conv_id").join(nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent")
    placed_nodes = near.where(F.col("parent_conv_id").isNotNull() | F.col("parent").isNull()).unionByName(far)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    out = placed_nodes.join(children, "node", "left").join(rolled, "node", "left").join(digests, "node", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", zero("n_children"), zero("n_leaves"), zero("saved_tokens"), F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())).alias("ends_sha256"))
