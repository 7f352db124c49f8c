"""Quality rules of documents, and of the hosts they come from.

Each document is measured whole. For each rule the failures are counted by host; a beta prior is fitted
to the hosts' rates by the moments of a beta-binomial, so that hosts of different sizes weigh by their
documents and the spread that small numbers make by chance does not count; and each host's rate is
shrunk towards the prior's mean. A host whose shrunk rate stands out is rejected with all its documents:
one bad page does not reject a small host, a thousand bad pages reject a large one.

Defined results: a null text has no words and fails; a null host is no host, so its documents are
judged alone; repeated rows count and come back each; an empty table gives an empty result; where no
host differs from the rest beyond chance all shrunk rates are the mean and no host is rejected; other
columns pass through, but for the names of new ones, which raise ValueError. Texts are read whole, one
at a time. The host table has one row for each host; it is broadcast to the documents while it is
small, and beyond that a hot host's rows are left to Spark's skew join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.llm.common import free_names, map_arrow, smaller, stage, text_first, with_columns

SYMBOLS = "#*$%&|<>"
#: Words in a window, and the share of repeated words beyond which a text fails.
WINDOW, MOST_REPEATED = 5, 0.2
LEAST_WORDS = 10
#: A host is rejected when its shrunk failure rate of a rule is above the prior's mean by more than SPREADS
#: of its standard deviations, and above HOST_FLOOR; above HOST_CEILING always.
SPREADS, HOST_FLOOR, HOST_CEILING = 2.0, 0.25, 0.5
#: Documents that the prior weighs as much as at least, so that one page never rejects its host.
LEAST_WEIGHT = 4.0
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes]) -> int:
    """Words inside five-word windows that the text has twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    # Number the windows by doubling: equal numbers are equal runs of words, with no hashing.
    pair = np.unique(ids[:-1] * len(numbers) + ids[1:], return_inverse=True)[1]
    most = int(pair.max()) + 1
    four = np.unique(pair[:-2] * most + pair[2:], return_inverse=True)[1]
    five, counts = np.unique(four[:n] * len(numbers) + ids[WINDOW - 1 :], return_inverse=True, return_counts=True)[1:]
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(counts[five] > 1)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def measure_text(text: str) -> tuple[int, int, int, int, int]:
    words = text.encode().split()  # bytes.split() takes exactly the six ASCII blanks
    blanks = sum(map(text.count, " \t\n\v\f\r"))
    lines = [x for x in text.split("\n") if x.encode().strip()] if "\n" in text else []
    return len(words), len(text) - blanks, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def measure(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all by default) and the measures of each text."""
    keep = df.columns if keep is None else keep
    if clash := set(MEASURES) & set(keep):
        raise ValueError(f"columns in the way: {sorted(clash)}")
    schema = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(m, T.LongType()) for m in MEASURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure_text(t.as_py() or "") for t in batch.column(0)]
            columns = list(zip(*found, strict=True)) if found else [[]] * len(MEASURES)
            rest = batch.select(batch.schema.names[1:]).rename_columns(keep)
            yield with_columns(rest, keep, **{m: pa.array(c, pa.int64()) for m, c in zip(MEASURES, columns, strict=True)})

    return map_arrow(text_first(df, text, keep), run, schema)


#: What fails a document (the first two), and what only counts against its host.
RULES: dict[str, Callable[[], Column]] = {
    "short": lambda: F.col("n_words") < LEAST_WORDS,
    "repeated": lambda: 100 * F.col("n_repeat_words") > int(100 * MOST_REPEATED) * F.col("n_words"),
    "symbols": lambda: 10 * F.col("n_symbols") > F.col("n_words"),
    "lines": lambda: 10 * F.col("n_dup_lines") > F.col("n_words"),
}


def base_failed() -> Column:
    return RULES["short"]() | RULES["repeated"]()


def host_rates(measured: DataFrame, host: str, rules: list[str]) -> DataFrame:
    """Of each host: n_docs, and for each rule the documents that fail it, the shrunk rate (the mean of the
    rate's posterior under the fitted prior) and the limit, null where the hosts' rates do not vary.

    With m the share of all documents that fail, n and r a host's documents and its rate, the sum of
    n (r - m)^2 over K hosts of N documents is expected to be (K - 1) m (1 - m) + (N - K) v for rates
    that vary by v. The prior's weight is m (1 - m) / v - 1, at least LEAST_WEIGHT, and beyond all numbers
    where v is 0.
    """
    failed = [F.sum(RULES[r]().cast("long")).alias(f"failed_{r}") for r in rules]
    hosts = measured.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n_docs"), *failed)
    n, m = F.col("n_docs"), {r: F.sum(f"failed_{r}") / F.sum("n_docs") for r in rules}
    # n (r - m)^2 adds up to the sum of f^2 / n, less N m^2, for f documents that fail.
    spread = {r: F.sum(F.col(f"failed_{r}") ** 2 / n) - F.sum(n) * m[r] ** 2 - (F.count("*") - 1) * m[r] * (1 - m[r]) for r in rules}
    prior = hosts.agg(*(e for r in rules for e in (m[r].alias(f"m_{r}"), F.greatest(F.lit(0.0), F.coalesce(F.try_divide(spread[r], F.sum(n) - F.count("*")), F.lit(0.0))).alias(f"v_{r}"))))
    out = ["host", "n_docs"]
    for r in rules:
        m, v = F.col(f"m_{r}"), F.col(f"v_{r}")
        weight = F.greatest(F.lit(LEAST_WEIGHT), F.coalesce(F.try_divide(m * (1 - m), v) - 1, F.lit(1e12)))
        limit = F.when(v > 0, F.least(F.lit(HOST_CEILING), F.greatest(F.lit(HOST_FLOOR), m + SPREADS * F.sqrt(v))))
        out += [f"failed_{r}", ((F.col(f"failed_{r}") + m * weight) / (n + weight)).alias(f"rate_{r}"), limit.alias(f"limit_{r}")]
    # The prior is one row, so this join only adds constants to each host.
    return hosts.crossJoin(F.broadcast(prior)).select(*out)


def judge(df: DataFrame, host: str = "source", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns and measures of every document, base_failed, its host's rates by rule (null without
    a host), host_rule (the first rule that rejects the host, null if none does) and kept."""
    keep = [c for c in df.columns if c != text] if keep is None else keep
    rates = [f"rate_{r}" for r in RULES]
    if clash := {"base_failed", "host_rule", "kept", *rates} & set(keep):
        raise ValueError(f"columns in the way: {sorted(clash)}")
    (at,) = free_names(keep, "_host")
    measured = stage(measure(df.withColumn(at, F.col(host).cast("string")), text, [*keep, at]).withColumn("base_failed", base_failed()), "quality")
    reject = F.coalesce(*(F.when(F.col(f"rate_{r}") > F.col(f"limit_{r}"), F.lit(r)) for r in RULES))
    hosts = stage(host_rates(measured, at, list(RULES)).select(F.col("host").alias(at), *rates, reject.alias("host_rule")), "hosts")
    out = measured.join(smaller(hosts), at, "left")
    return out.select(*keep, *MEASURES, "base_failed", *rates, "host_rule", (~F.col("base_failed") & F.col("host_rule").isNull()).alias("kept"))
