"""Benchmark decontamination by winnowing, in DataFrame operations only.

A text's fingerprints are the least GRAM-word hashes of its sliding windows of hashes, so two texts that
share WINDOW words share a fingerprint. Documents' fingerprints are joined with the benchmark's; each
hit is extended to the windows of words that contain it, and those are joined with the benchmark's
windows word for word. Only documents with a hit are looked at again.

An item of fewer than WINDOW words is one window by itself. Winnowing guarantees nothing at that length,
so documents also give the hashes of all their n-grams for each such length n there is.

Hashes are cut to 32 bits beside a gram's place; that makes chance hits, which the words then refute, and
loses none.

Defined results: a null text has no words; an item without words is ignored; a null item_id hits but is
not counted among the items; items that share an id are one item; rows that share a doc_id are told
apart by their text, and identical rows come back each; empty tables give no hits; very long texts are
read whole; kept columns may have any name but those of the new ones, which raise ValueError.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import free_names, smaller, stage, text_key

#: Words in a benchmark window, in a fingerprinted gram, and grams in a winnowing window.
WINDOW, GRAM = 13, 5
WINNOW = WINDOW - GRAM + 1
#: Share of hit words from which a document is contaminated.
SHARE = 0.05
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def quick_words(text: Column) -> Column:
    """The same words folded further, at a fraction of the cost: words that are equal stay equal.

    lower() looks around a capital sigma only, so that one goes first.
    """
    return F.regexp_extract_all(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u03a3"), F.lit("\u03c3"))), F.lit(WORD), F.lit(0))


def cut_hash(*parts: Column) -> Column:
    """32 bits of a hash, above a place of 32 bits: the least of several is the leftmost least hash."""
    return F.shiftleft(F.xxhash64(*parts), 32)


def placed(hashes: str, n: int) -> Column:
    """Hash and place of each run of n words, by the column of their hashes, and nulls after the last."""
    return F.transform(hashes, lambda _, k: F.when(k <= F.size(hashes) - n, cut_hash(*(F.get(hashes, k + j) for j in range(n))).bitwiseOR(k.cast("long"))))


def shifted(numbers: str, by: int) -> Column:
    return F.slice(numbers, by + 1, F.size(numbers))


def with_prints(df: DataFrame, short: list[int]) -> DataFrame:
    """df (with words) and prints: h, at and n of every fingerprint; n is 0 for a winnowed one.

    A lambda works out its outer arrays anew for each element, so each array is a column first. The least
    of WINNOW grams from each place on comes from leasts of 2, 4 and 8.
    """
    df = df.withColumn("_w", F.transform("words", lambda w: F.xxhash64(w))).withColumn("_m1", placed("_w", GRAM))
    for size in (1, 2, 4):
        df = df.withColumn(f"_m{2 * size}", F.zip_with(f"_m{size}", shifted(f"_m{size}", size), lambda a, b: F.least(a, b)))
    df = df.withColumn("_least", F.zip_with("_m8", shifted("_m1", WINNOW - 1), lambda a, b: F.least(a, b)))
    whole = F.greatest(F.size("words") - (WINDOW - 1), F.lit(0))  # windows there are
    df = df.withColumn("_m", F.array_distinct(F.slice("_least", 1, whole)))
    for n in short:
        df = df.withColumn(f"_s{n}", placed("_w", n))
    at = lambda v: v.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    told = lambda c, n: F.transform(c, lambda v: F.struct(F.shiftright(v, 32).alias("h"), at(v).alias("at"), F.lit(n).alias("n")))
    kinds = [told("_m", 0), *(told(F.filter(f"_s{n}", lambda v: v.isNotNull()), n) for n in short)]
    return df.withColumn("prints", F.concat(*kinds)).drop("_w", "_m", "_m1", "_m2", "_m4", "_m8", "_least", *(f"_s{n}" for n in short))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, n (words in the window) and window (its words, joined by blanks) of every window."""
    words = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    n = F.least(F.size("words"), F.lit(WINDOW))
    each = words.select("item_id", "words", n.alias("n"), F.explode(F.sequence(F.lit(0), F.size("words") - n)).alias("k"))
    return each.select("item_id", "n", F.array_join(F.slice("words", F.col("k") + 1, F.col("n")), " ").alias("window"))


def item_prints(benchmark: DataFrame, short: list[int]) -> DataFrame:
    """h, n: fingerprints of long items (n: 0) and hashes of whole short ones (n: all their words)."""
    words = benchmark.select(quick_words(F.col("text")).alias("words"))
    size = F.size("words")
    prints = with_prints(words.withColumn("size", size), short).select("size", F.explode_outer("prints").alias("f")).select("size", "f.h", "f.n")
    return prints.where(F.when(F.col("size") >= WINDOW, F.col("n") == 0).otherwise(F.col("n") == F.col("size"))).select("h", "n").distinct()


def lengths_of_short(benchmark: DataFrame) -> list[int]:
    """Words of the items that have fewer than WINDOW: at most WINDOW - 1 numbers."""
    sizes = benchmark.select(F.size(words_of(F.col("text"))).alias("n")).where((F.col("n") > 0) & (F.col("n") < WINDOW))
    return sorted(r.n for r in sizes.distinct().collect())


def keyed(documents: DataFrame) -> tuple[DataFrame, str, str]:
    """documents and the names of two columns that tell their texts apart."""
    i, k = free_names([*documents.columns, "words", "prints", "near", "f", "h", "n", "at", "kept"], "_id", "_tk")
    return documents.withColumns({i: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), k: text_key(F.col("text"))}), i, k


def fingerprints(documents: DataFrame, benchmark: DataFrame, keep: list[str], counted: bool) -> DataFrame:
    """id, tk, at and n of every fingerprint that the benchmark has too; if counted also a row for each
    document with n = -1, its number of words in `at` and the kept columns in `kept`."""
    short = lengths_of_short(benchmark)
    prints = smaller(stage(item_prints(benchmark, short), "item-prints").withColumn("found", F.lit(True)))
    docs, i, k = keyed(documents)
    kept = F.struct(*(F.col(c).alias(f"c{j}") for j, c in enumerate(keep))) if keep else F.struct(F.lit(1).alias("none"))
    words = with_prints(docs.select(F.col(i).alias("id"), F.col(k).alias("tk"), *([kept.alias("kept")] if counted else []), quick_words(F.col("text")).alias("words")), short)
    if not counted:
        return words.select("id", "tk", F.explode_outer("prints").alias("f")).select("id", "tk", "f.*").join(prints, ["h", "n"]).select("id", "tk", "at", "n")
    whole = F.array(F.struct(F.xxhash64("id", "tk").alias("h"), F.size("words").alias("at"), F.lit(-1).alias("n")))
    rows = words.select("id", "tk", "kept", F.explode_outer(F.concat(whole, "prints")).alias("f")).select("id", "tk", F.when(F.col("f.n") == -1, F.col("kept")).alias("kept"), "f.*")
    return rows.join(prints, ["h", "n"], "left").where(F.col("found") | (F.col("n") == -1)).select("id", "tk", "at", "n", "kept")


def hits_of(documents: DataFrame, benchmark: DataFrame, found: DataFrame) -> DataFrame:
    """id, tk, n_words, n_hit and items of the documents in which a window occurs, by the fingerprints found in them."""
    # The windows that contain a hit: those of WINDOW words around a fingerprint, or the short run itself.
    size = F.when(F.col("n") == 0, WINDOW).otherwise(F.col("n"))
    first = F.when(F.col("n") == 0, F.greatest(F.col("at") - (WINDOW - GRAM), F.lit(0))).otherwise(F.col("at"))
    near = found.where(F.col("n") >= 0).select("id", "tk", size.alias("size"), F.explode(F.sequence(first, F.col("at"))).alias("k"))
    wanted = stage(near.groupBy("id", "tk").agg(F.collect_set(F.struct("k", "size")).alias("near")), "near")
    docs, i, k = keyed(documents)
    again = docs.select(F.col(i).alias("id"), F.col(k).alias("tk"), "text").join(smaller(wanted), ["id", "tk"]).dropDuplicates(["id", "tk"]).select("id", "tk", words_of(F.col("text")).alias("words"), "near")
    window = F.transform("near", lambda w: F.struct(w["k"].alias("k"), w["size"].alias("n"), F.array_join(F.slice("words", w["k"] + 1, w["size"]), " ").alias("window")))
    windows = again.select("id", "tk", F.size("words").cast("long").alias("n_words"), F.explode(window).alias("w")).select("id", "tk", "n_words", "w.*")
    items = item_windows(benchmark).groupBy("n", "window").agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    hits = windows.join(items, ["n", "window"]).groupBy("id", "tk").agg(F.first("n_words").alias("n_words"), F.collect_set(F.struct("k", "n")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("items"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["k"], r["k"] + r["n"] - 1)))))
    return stage(hits.select("id", "tk", "n_words", covered.cast("long").alias("n_hit"), "items"), "contaminated")


def is_contaminated() -> Column:
    return (F.col("n_hit") > 0) & (F.col("n_hit") * round(1 / SHARE) >= F.col("n_words"))


def contamination(documents: DataFrame, benchmark: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The kept columns of every document (doc_id by default), n_words, n_hit, items and contaminated.

    items: the item_ids with a window in the document, as strings, in order. Kept columns travel with the
    fingerprints, so that only documents with hits are joined; long ones are better left out.
    """
    keep = ["doc_id"] if keep is None else keep
    if clash := {"n_words", "n_hit", "items", "contaminated"} & set(keep):
        raise ValueError(f"columns in the way: {sorted(clash)}")
    found = stage(fingerprints(documents, benchmark, keep, counted=True), "hits")
    hits = hits_of(documents, benchmark, found)
    told = found.where(F.col("n") == -1).select("id", "tk", "kept", F.col("at").cast("long").alias("n_words")).join(smaller(hits.select("id", "tk", "n_hit", "items")), ["id", "tk"], "left")
    told = told.select("kept", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return told.select(*(F.col("kept")[f"c{j}"].alias(c) for j, c in enumerate(keep)), "n_words", "n_hit", "items", is_contaminated().alias("contaminated"))


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of documents that are not contaminated, with their columns."""
    found = stage(fingerprints(documents, benchmark, [], counted=False), "hits")
    docs, i, k = keyed(documents)
    dirty = hits_of(documents, benchmark, found).where(is_contaminated()).select(F.col("id").alias(i), F.col("tk").alias(k))
    return docs.join(smaller(dirty), [i, k], "left_anti").select(*documents.columns)
