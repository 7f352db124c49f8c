"""Secret scan: fixed patterns, and a token-efficiency test for random strings.

A random string costs a subword vocabulary many tokens: it gets few characters out of each. Runs of
key characters with a low ratio are reported; separators, digests, UUIDs and numbers, which are known not to be
secrets, do not count. The patterns' own spans always stay.

Defined results: a null text scans as an empty one; an empty text has no spans; an empty table gives an
empty result; a repeated row is scanned again; other columns pass through, but for a column secret_spans, which raises ValueError. Texts
are scanned whole, one at a time, with no shuffle, in time that grows with their length; spans that start
together come in the order of KINDS.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.llm.bytebpe import read_ranks
from kerbside.llm.common import give_back, map_arrow, text_first, with_columns

#: Characters for each token below which a run counts as random.
CHARS_PER_TOKEN = 2.2
#: Shortest run that is judged as one, and fewest letters of a plain word that are judged inside a run.
LEAST_RUN = 20
#: Fewest characters judged at all, without separators, UUIDs, digests and numbers.
LEAST_KEY = 12

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST_KEY},}}")
#: Digest lengths in hex digits (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512).
DIGEST_DIGITS = {32, 40, 56, 64, 96, 128}
HEX_ONLY = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
UUID = re.compile(r"(?<![0-9A-Za-z])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![0-9A-Za-z])")
#: What lies between separators.
PART = re.compile(r"[A-Za-z0-9]+")
#: Letters of one case, or a capital before small ones: a word may look so, and rare ones cost many tokens.
PLAIN = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+)\Z")
#: One character again and again, a number or a time.
NUMBER = re.compile(r"(?:(.)\1*|[0-9]+(?:T[0-9]+)?Z?)\Z")


def fixed(part: str) -> bool:
    """A digest of known length or a number."""
    return bool((len(part) in DIGEST_DIGITS and HEX_ONLY.match(part)) or NUMBER.match(part))


@lru_cache(2)
def vocabulary(content: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}
    return tiktoken.Encoding("runs", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by the fixed patterns, leftmost and non-overlapping for each kind."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    return sorted(spans + [(m.start(), 2, m.end()) for m in HEX.finditer(text)])


def parts(run: str, encoding) -> list[tuple[int, int, list[int]]]:
    """(start, end, characters of each token) of the parts that may be random: no separators, UUIDs, digests or numbers."""
    open_run = UUID.sub(lambda m: "-" * len(m[0]), run)
    return [(m.start(), m.end(), [len(t) for t in encoding.decode_tokens_bytes(encoding.encode_ordinary(m[0]))]) for m in PART.finditer(open_run) if not fixed(m[0])]


def gains(part: tuple[int, int, list[int]], ratio: float) -> list[float]:
    """By how many characters each token falls short of the ratio. A part of one token is a word and never short."""
    start, end, sizes = part
    return [min(0.0, ratio - sizes[0])] if len(sizes) == 1 and end - start > 1 else [ratio - n for n in sizes]


def short_windows(tokens: list[tuple[int, int, int, float]], least: int) -> Iterator[tuple[int, int]]:
    """(start, end) of all windows that fall short, of tokens (start, end, characters that count, gain), without tokens at their ends that do not.

    From each token on, the shortest window of `least` characters that count; and all tokens.
    """
    k, held, gain = 0, 0, 0.0
    windows = [(0, len(tokens), sum(t[3] for t in tokens))] if sum(t[2] for t in tokens) >= least else []
    for j, token in enumerate(tokens):
        held, gain = held + token[2], gain + token[3]
        while held - tokens[k][2] >= least:
            held, gain, k = held - tokens[k][2], gain - tokens[k][3], k + 1
        if held >= least:
            windows.append((k, j + 1, gain))
    for k, end, gain in windows:
        if gain > 1e-9:
            while tokens[k][3] <= 0:
                k += 1
            while tokens[end - 1][3] <= 0:
                end -= 1
            yield tokens[k][0], tokens[end - 1][1]


def random_parts(run: str, judged: list[tuple[int, int, list[int]]], ratio: float) -> list[tuple[int, int]]:
    """(start, end) of whole parts of a run that hold a window below the ratio, so that words beside a key do not hide it."""
    mixed, found = [], []
    for part in judged:
        at, tokens, plain = part[0], [], bool(PLAIN.match(run[part[0] : part[1]]))
        for n, gain in zip(part[2], gains(part, ratio), strict=True):
            tokens.append((at, at + n, n, gain))
            at += n
        if plain and part[1] - part[0] >= LEAST_RUN:
            found += short_windows(tokens, LEAST_RUN)
        mixed += [(s, e, 0, min(0.0, g)) for s, e, _, g in tokens] if plain else tokens
    found += short_windows(mixed, LEAST_KEY)
    starts, ends = [s for s, _, _ in judged], [e for _, e, _ in judged]
    out: list[tuple[int, int]] = []
    for s, e in sorted({(starts[bisect_right(starts, s) - 1], ends[bisect_left(ends, e)]) for s, e in found}):
        while run[e : e + 1] == "=":  # base64's padding
            e += 1
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def random_spans(text: str, encoding, ratio: float) -> list[tuple[int, int, int]]:
    """Runs that cost many tokens, else their parts that do. Only the vocabulary judges letters: common words are cheap."""
    found = []
    for m in RUN.finditer(text):
        judged = parts(m[0], encoding)
        if sum(e - s for s, e, _ in judged) < LEAST_KEY:
            continue
        if len(m[0]) >= LEAST_RUN and sum(sum(gains(p, ratio)) for p in judged) > 0:
            found.append((m.start(), 3, m.end()))
        else:
            found += [(m.start() + s, 3, m.start() + e) for s, e in random_parts(m[0], judged, ratio)]
    return found


def outside(found: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """Those of the found spans that no base span holds; both are in order of their starts."""
    k, reach = 0, 0
    for span in found:
        while k < len(base) and base[k][0] <= span[0]:
            reach = max(reach, base[k][2])
            k += 1
        if span[2] > reach:
            yield span


def spans_of(text: str, encoding, ratio: float) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans, in order."""
    base = base_spans(text)
    return sorted([*base, *outside(random_spans(text, encoding, ratio), base)])


def scan(df: DataFrame, ranks_path: str, pattern: str, ratio: float = CHARS_PER_TOKEN, text: str = "text") -> DataFrame:
    """All columns of df and `secret_spans`: kind, start and end (code points, end exclusive), in order.

    A random run inside a span of the patterns is not reported twice.
    """
    if "secret_spans" in df.columns:
        raise ValueError("column in the way: secret_spans")
    content = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    keep = df.columns
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([*df.schema.fields, T.StructField("secret_spans", T.ArrayType(span))])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = vocabulary(content.value, pattern)
        for batch in batches:
            out = []
            for value in batch.column(0):
                out.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans_of(value.as_py() or "", encoding, ratio)])
            rest = batch.select(batch.schema.names[1:]).rename_columns(keep)
            yield with_columns(rest, keep, secret_spans=pa.array(out, arrow))
        give_back()

    return map_arrow(text_first(df, text, keep), run, schema)


def redact(df: DataFrame, mark: str = "[secret]", text: str = "text") -> DataFrame:
    """The texts of scan() with every span replaced by the mark; overlapping spans become one."""
    whole, spans = F.col(text), F.col("secret_spans")
    step = lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(
        F.struct(
            F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.substring(whole, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).alias("out"),
            s["end"].alias("at"),
        )
    )
    end = lambda acc: F.concat(acc["out"], F.substring(whole, acc["at"] + 1, F.length(whole)))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    return df.withColumn(text, F.when(F.size(spans) > 0, F.aggregate(spans, start, step, end)).otherwise(whole))

