"""The corpus operators against brute force, libraries and round trips, with their edge cases."""

import base64
import hashlib
import os
import random
import re
import subprocess
import sys
import time
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kerbside.llm import bytebpe, common, contamination, dartminhash, language, quality, secrets, substrings, toxicity, urls, wavelet

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
#: Nulls, empty texts, repeated rows, one doc_id twice, a null doc_id and a very long text.
ODD = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (4, "x y"), (4, "z z"), (None, "no id " * 30), (6, "long text " * 20000), (7, " \n\t "), (8, "éßΣ İ <|endoftext|> don't '' 's 12½ 😀́")]


def frame(spark, rows, columns="doc_id long, text string"):
    return spark.createDataFrame(rows, columns)


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


# 10 byte-level BPE


@lru_cache(1)
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library():
    dice = random.Random(3)
    signs = "  \n\tabstmdlverREL'''12½,.!#é中ñ \r\x00\x1c\x85😀ٱ"
    texts = ["".join(dice.choice(signs) for _ in range(dice.randint(0, 40))) for _ in range(2000)] + ["", " ", "a" * 3000, "''s's'll'lla don't I'm", "　  x"]
    enc, content = library(), bytebpe.read_ranks(RANKS)
    for text, (ids, offsets) in zip(texts, bytebpe.encode_texts(texts, content), strict=True):
        assert enc.encode_ordinary(text) == ids.tolist()
        assert bytebpe.decode_ids(ids, offsets, content) == text.encode()


def test_every_code_point_has_the_librarys_class():
    enc, content = library(), bytebpe.read_ranks(RANKS)
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    for lo in range(0, len(points), 100_000):
        texts = ["".join(f"{chr(c)}'s\0" for c in points[k : k + 1000]) for k in range(lo, min(lo + 100_000, len(points)), 1000)]
        for text, (ids, _) in zip(texts, bytebpe.encode_texts(texts, content), strict=True):
            assert enc.encode_ordinary(text) == ids.tolist()


def test_bpe_rows(odd, empty):
    extra = odd.withColumns({"lang": F.lit("x"), "_text": F.lit(1)})
    coded = bytebpe.encode(extra, RANKS)
    assert coded.columns == ["doc_id", "lang", "_text", "ids", "offsets", "n_tokens"]
    back = bytebpe.decode(coded.select("doc_id", "ids", "offsets"), RANKS).collect()
    assert sorted((r.doc_id or 0, bytes(r.bytes).decode()) for r in back) == sorted((i or 0, t or "") for i, t in ODD)
    assert bytebpe.encode(empty, RANKS, with_bytes=True).count() == 0
    with pytest.raises(ValueError):
        bytebpe.encode(odd.withColumn("ids", F.lit(1)), RANKS)


def test_classes_of_code_points_take_little_memory():
    """Two workers of an executor make them at the same time; all at once they took some 120 MB each."""
    code = f"import sys; sys.path.insert(0, {os.path.dirname(os.path.dirname(bytebpe.__file__.rsplit('/', 1)[0]))!r})\n" + """
import re, tiktoken
from kerbside.llm import bytebpe
most = lambda: int(re.search(r"VmHWM:\\s+(\\d+)", open("/proc/self/status").read()).group(1)) / 1024
tiktoken.Encoding("warm", pat_str=r"\\s", mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={}).encode_ordinary("a ")
before = most()
bytebpe.code_point_classes()
print(most() - before)
"""
    assert float(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) < 40


def test_checked_ids_need_no_bytes(spark, odd):
    coded = bytebpe.encode(odd, RANKS, keep=["doc_id"], checked=True)
    assert coded.columns == ["doc_id", "ids", "intact", "n_tokens"] and coded.where("NOT intact").count() == 0
    key = lambda r: (str(r.doc_id), bytes(r.ids), r.n_tokens)
    assert sorted(map(key, coded.collect())) == sorted(map(key, bytebpe.encode(odd, RANKS, keep=["doc_id"]).collect()))


# 5 wavelet shards


def test_wavelet_matrix_answers():
    ids = np.random.default_rng(0).integers(0, 300, 5000).astype(np.uint16)
    m = wavelet.WaveletMatrix.build(ids, 9)
    assert (m.all_ids() == ids).all() and all(m.access(k) == ids[k] for k in range(0, 5000, 97))
    for token in (0, 7, 255, 299):
        assert m.count(token) == (ids == token).sum() and m.positions(token) == np.flatnonzero(ids == token).tolist()
    assert wavelet.WaveletMatrix.build(ids[:0], 9).all_ids().tolist() == []


def test_shards_hold_the_librarys_ids_in_order(spark, odd, tmp_path):
    tokenizer = Tokenizer.from_file(WORDS)
    wavelet.write_shards(odd, str(tmp_path / "t"), WORDS, 2, shard_tokens=50)
    shards = wavelet.read_shards(spark, str(tmp_path / "t"))
    rows = sorted(wavelet.read_documents(shards).collect(), key=lambda r: r.start)
    texts = sorted(ODD, key=lambda r: (-1 if r[0] is None else r[0], r[1] is not None, r[1]))
    start = 0
    for r, (doc_id, text) in zip(rows, texts, strict=True):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, bytes(r.ids)) == (doc_id, start, len(ids), np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert wavelet.count_token(shards, 2).agg(F.sum("n")).first()[0] == len(ODD)
    ends = sorted(r.position for r in wavelet.locate_token(shards, 2).collect())
    assert ends == [r.start + r.n_tokens - 1 for r in rows]


def test_latin_words_take_the_model_alone(monkeypatch):
    """Punctuation, numbers and contractions too: the library's pipeline costs several times as much."""
    content = open(WORDS, "rb").read()
    enc, library, dice = wavelet.WordEncoder(content), Tokenizer.from_str(content.decode()), random.Random(3)
    latin, other = [chr(k) for k in range(256) if chr(k) != "|"], [*"ab'ré2. \n", *map(chr, range(0x180)), *"\u0301Σςİﬁ中あ한😀", "<|endoftext|>"]
    texts = ["", " ", "don't, we'll!! 3.14 x²½ ab''s", *("".join(dice.choices(latin, k=dice.randint(0, 60))) for _ in range(2000))]
    want = lambda some: [np.array(e.ids, enc.kind).tobytes() for e in library.encode_batch_fast(some, add_special_tokens=False)]
    mixed = ["".join(dice.choices(other, k=dice.randint(0, 40))) for _ in range(2000)] + texts[:5]
    monkeypatch.setattr(wavelet, "CACHE_WORDS", 500)  # words are forgotten and met again
    assert [i for k in range(0, len(mixed), 90) for i in enc.encode(mixed[k : k + 90])] == want(mixed)
    asked = []
    monkeypatch.setattr(enc, "by_library", lambda words: asked.extend(words))
    assert enc.encode(texts) == want(texts) and not asked


def test_no_documents_make_no_shards(spark, empty, tmp_path):
    wavelet.write_shards(empty, str(tmp_path / "t"), WORDS, 2)
    assert wavelet.read_documents(wavelet.read_shards(spark, str(tmp_path / "t"))).count() == 0


# queries that SQL can express


def as_sets(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize("broadcast", [True, False])
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_queries_equal_their_sql(spark, monkeypatch, sf, broadcast):
    import duckdb

    from kerbside.llm import catalog, common

    if not broadcast:  # what a large input does
        if sf == "sf0.01":
            return
        monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    db = duckdb.connect()
    db.sql("SET TimeZone = 'UTC'")
    for name in ("documents", "benchmark", "pages", "embeddings", "conversations"):
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/{sf}/{name}.parquet'")
    for name, sql in catalog.ORACLES.items():
        want = db.sql(sql)
        got = catalog.QUERIES[name](spark, f"/root/testdata/{sf}")
        assert sorted(got.columns) == sorted(want.columns), name
        columns = sorted(got.columns)
        assert as_sets(map(tuple, got.select(*columns).collect())) == as_sets(want.select(*(f'"{c}"' for c in columns)).fetchall()), name


# 1 secrets


def test_patterns_take_the_leftmost_match_and_then_drop_short_ones():
    assert secrets.base_spans("password: token = abcdefghijklmnop") == []
    text = "API-KEY x Secret='AbC-def_1234' AKIA" + "A1" * 7 + " " + "0f" * 8
    assert [(k, text[a:b]) for a, k, b in secrets.base_spans(text)] == [(0, "Secret='AbC-def_1234"), (1, "AKIA" + "A1" * 7), (2, "0f" * 8)]
    assert secrets.base_spans("paſsword=abcdefghijklmnop") == []


def test_random_runs_are_found_and_names_are_not(spark):
    key = "q7Zx9KfP2vLw8RtY3mNb"
    texts = [f"use {key} now", "d41d8cd98f00b204e9800998ecf8427e", "123e4567-e89b-12d3-a456-426614174000", "some_long_snake_case_identifier_name", "SomeLongCamelCaseIdentifier", "0" * 30, "https://example.org/a/path/of/words", None, ""]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.secret_spans] for r in secrets.scan(frame(spark, list(enumerate(texts))), RANKS, public_tokenizers.PATTERN).collect()}
    assert got[0] == [("random", 4, 24)] and got[1] == [("hex", 0, 32)]
    assert all(all(s[0] == "hex" for s in v) for k, v in got.items() if k > 1)


def test_letters_are_judged_by_the_vocabulary():
    spans = lambda text: secrets.random_spans(text, library(), secrets.CHARS_PER_TOKEN)
    for key in ("xkqzvbnwjhgfdsrtplmc", "kq72xv9mzpt384hwbn51", "XKQZVBNWJHGFDSRTPLMC"):
        assert spans(f"use {key} now") == [(4, 3, 24)]
    for name in ("com/blog/2024/01/15/the-title-of-this-page-12345", "btn-xs-ml-2-mr-2-pt-3-pb-4-md-6", "backup-2024-01-15T12-30-00Z", "internationalization", "MAXIMUM_VALUE_EXCEEDED_ERROR", "img/123e4567-e89b-12d3-a456-426614174000/d41d8cd98f00b204e9800998ecf8427e"):
        assert spans(name) == []


def test_words_beside_a_key_do_not_hide_it():
    found = lambda text: [text[a:b] for a, _, b in secrets.random_spans(text, library(), secrets.CHARS_PER_TOKEN)]
    words = "international/organization/administration/documentation"
    for key in ("q7Zx9KfP2vLw8RtY3mNbXc5d", "q7Zx9KfP2vLw", "kq72xv9mzpt384", "xkqzvbnwjhgfdsrtplmc", "q7Zx9KfP2vLw8RtY3mNbXQ=="):
        assert found(f"{words}/{key}") == [key] and found(f"{words}/{key}/{words}") == [key]
    assert found("international" * 3 + "q7Zx9KfP2vLw8RtY") == ["international" * 3 + "q7Zx9KfP2vLw8RtY"]
    assert found(f"{words}/q7Zx9Kf+P2vLw8/R4t") == ["q7Zx9Kf+P2vLw8/R4t"]
    assert found("id q7Zx9KfP2vLw") == ["q7Zx9KfP2vLw"] and found("id q7Zx9KfP2vL") == []
    for name in (words, "SomeLongCamelCaseIdentifier", "whederlyblend", f"{words}/2024-01-15T12-30-00Z", "lib/x86_64-linux-gnu/python3", "win32x64setup", f"{words}/123e4567-e89b-12d3-a456-426614174000/x"):
        assert found(name) == []


def slow_spans(text):
    """The contract's patterns read again, without the scanner's shortcuts, and random spans outside them."""
    out = []
    for kind, pattern, least in (("assign", r"""(?a)(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 0), ("access", "AKIA[A-Z0-9]+", 18), ("hex", "[0-9a-f]+", 16)):
        at = 0
        while m := re.compile(pattern).search(text, at):
            at = m.end()
            if len(m[2]) >= 12 if kind == "assign" else m.end() - m.start() >= least:
                out.append((m.start(), ["assign", "access", "hex", "random"].index(kind), m.end()))
    more = [s for s in secrets.random_spans(text, library(), secrets.CHARS_PER_TOKEN) if all(not (b[0] <= s[0] and s[2] <= b[2]) for b in out)]
    return sorted(out), sorted(out + more)


def test_the_query_equals_a_plain_reading(spark):
    from kerbside.llm import catalog

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: r for r in catalog.op1_secrets(spark, "/root/testdata/sf0.001").collect()}
    listed = lambda spans: ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
    assert len(got) == len(docs)
    for d in docs:
        base, every = slow_spans(d.text or "")
        r = got[d.doc_id]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in base) for k in range(3))
        assert (r.base_sha256, r.spans) == (hashlib.sha256(listed(base).encode()).hexdigest(), listed(every))


def test_spans_inside_base_spans_are_not_told_again():
    dice = random.Random(12)
    for _ in range(200):
        base = sorted((a, dice.randint(0, 2), a + dice.randint(1, 20)) for a in (dice.randint(0, 80) for _ in range(6)))
        found = sorted((a, 3, a + dice.randint(1, 15)) for a in (dice.randint(0, 90) for _ in range(8)))
        assert list(secrets.outside(found, base)) == [s for s in found if not any(b[0] <= s[0] and s[2] <= b[2] for b in base)]


def test_long_runs_are_read_in_linear_time():
    dice = random.Random(5)
    enc = library()
    secrets.spans_of("warm up", enc, secrets.CHARS_PER_TOKEN)
    for signs in ("abcdefghijklmnopqrstuvwxyz", "acgt", "abcdefghijklmnopqrstuvwxyz0123456789"):
        text = "".join(dice.choices(signs, k=1_000_000))
        started = time.monotonic()
        secrets.spans_of(text, enc, secrets.CHARS_PER_TOKEN)
        assert time.monotonic() - started < 30
    many = "token=abcdefghijklmnop q7Zx9KfP2vLw8RtY3mNb " * 20_000
    started = time.monotonic()
    assert len(secrets.spans_of(many, enc, secrets.CHARS_PER_TOKEN)) == 40_000 and time.monotonic() - started < 60


def test_long_slugs_are_read_once():
    slugs = ["com/blog/" + "-".join(["words"] * 13) + "-12345", "com/blog/" + "-".join(["words"] * 13) + "-A", "abcd" * 9 + "12345"]
    started = time.monotonic()
    assert all(secrets.random_spans(s, library(), secrets.CHARS_PER_TOKEN) == [] for s in slugs[:2])
    secrets.random_spans(slugs[2], library(), secrets.CHARS_PER_TOKEN)
    assert time.monotonic() - started < 5


def test_redaction_replaces_every_span(spark, odd, empty):
    text = "a token = 'abcdefghijklmnop' b " + "9f" * 8 + " c"
    out = secrets.redact(secrets.scan(frame(spark, [(1, text)]), RANKS, public_tokenizers.PATTERN), "#").first().text
    assert out == "a #' b # c"
    same = secrets.redact(secrets.scan(odd, RANKS, public_tokenizers.PATTERN)).select("doc_id", "text").collect()
    assert sorted(map(repr, map(tuple, same))) == sorted(map(repr, ODD))
    assert secrets.scan(empty, RANKS, public_tokenizers.PATTERN).count() == 0


# 2 quality


def slow_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    runs = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    covered = {k + j for k, r in enumerate(runs) if runs.count(r) > 1 for j in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_measures_equal_brute_force():
    dice = random.Random(1)
    for _ in range(300):
        text = "".join(dice.choice(["a ", "b ", "c\n", "é\x85", "#", " ", "\r", "<|> "]) for _ in range(dice.randint(0, 60)))
        assert quality.measure_text(text) == slow_measures(text)


def test_hosts_change_verdicts(spark, empty):
    good = "one two three four five six seven eight nine ten eleven"
    bad = [(k, "bad", "x") for k in range(200)] + [(1000 + k, "bad", good) for k in range(20)]
    fair = [(k, f"h{k % 40}", good if k % 13 else "x") for k in range(2000, 2800)]
    odd = [(5000, "small", "x"), (5001, None, good), (5002, None, None), (5003, "signs", good), *((k, "signs", good + " # # #") for k in range(6000, 6100))]
    got = {r.doc_id: r for r in quality.judge(frame(spark, bad + fair + odd, "doc_id long, source string, text string")).collect()}
    table = {h: (r.host_rule, r.kept) for h, r in {"bad": got[1000], "h": got[2001], "small": got[5000], None: got[5001], "signs": got[5003]}.items()}
    assert table == {"bad": ("short", False), "h": (None, True), "small": (None, False), None: (None, True), "signs": ("symbols", False)}
    assert not got[1000].base_failed and not got[5002].kept and got[5001].rate_short is None
    assert got[5000].rate_short < got[0].rate_short < 1


def test_rates_without_any_spread_are_the_mean(spark):
    singles = [(k, f"h{k}", "x" if k % 4 == 0 else "a b c d e f g h i j") for k in range(400)]
    rows = quality.judge(frame(spark, singles, "doc_id long, source string, text string")).collect()
    assert {round(r.rate_short, 6) for r in rows} == {0.25} and not any(r.host_rule for r in rows)


def test_quality_rows(spark, odd, empty):
    assert quality.judge(empty.withColumn("source", F.lit("a"))).count() == 0
    rows = quality.judge(odd.withColumns({"source": F.lit("a"), "_host": F.lit("mine"), "host": F.lit(1)})).collect()
    assert len(rows) == len(ODD) and {r._host for r in rows} == {"mine"}
    assert {(r.n_words, r.n_repeat_words, r.base_failed) for r in rows if r.doc_id == 6} == {(40_000, 40_000, True)}
    for name in ("kept", "n_words", "host_rule", "base_failed", "rate_short"):
        with pytest.raises(ValueError):
            quality.judge(odd.withColumns({"source": F.lit("a"), name: F.lit(1)}))


# 3 substrings


def brute_force(texts: list[tuple[int, bytes]]) -> dict[int, tuple[int, int, str]]:
    """The same by a table of all windows: n_removed, n_spans and kept_sha256 by doc_id."""
    seen, out = set(), {}
    for doc_id, data in sorted(texts):
        gone = np.zeros(len(data) + 1, bool)
        for s in range(len(data) - substrings.WIDTH + 1):
            if data[s : s + substrings.WIDTH] in seen:
                gone[s : s + substrings.WIDTH] = True
            seen.add(data[s : s + substrings.WIDTH])
        kept = bytes(np.frombuffer(data, np.uint8)[~gone[:-1]])
        out[doc_id] = (int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def removed(spark, rows):
    got = substrings.digests(substrings.remove_repeats(frame(spark, rows))).collect()
    return {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in got}


@pytest.mark.parametrize("way", ["sort", "hot", "overflow"])
def test_repeats_equal_brute_force(spark, monkeypatch, way):
    if way == "hot":
        monkeypatch.setattr(substrings, "SAMPLED", 1)
        monkeypatch.setattr(substrings, "HOT_IN_SAMPLE", 2)
    dice = random.Random(5)
    base = "".join(dice.choice("ab \né") for _ in range(700))
    rows = []
    for k in range(60):
        a = dice.randint(0, 600)
        text = "".join(dice.choice("abcdefgh") for _ in range(dice.randint(0, 150))) + base[a : a + dice.randint(50, 400)] + "".join(dice.choice("ab") for _ in range(dice.randint(0, 200))) + ("a" * dice.randint(0, 300) if k % 3 == 0 else "")
        rows.append((k, text))
    rows += [(100, base), (101, base), (102, ""), (103, "short")]
    want = brute_force([(i, t.encode()) for i, t in rows])
    if way == "overflow":  # in one process, so that the small limits hold in it
        docs = sorted((i, t.encode()) for i, t in rows)
        assert overflown(docs, monkeypatch) == {i: w[0] for i, w in want.items()}
        return
    assert removed(spark, rows) == want


def overflown(docs, monkeypatch):
    """Bytes removed when every anchor with two spans gives its windows."""
    monkeypatch.setattr(substrings, "SORT_SPANS", 2)
    monkeypatch.setattr(substrings, "WINDOW_SPANS", 3)
    data = dict(docs)
    batch = pa.RecordBatch.from_pydict({"did": [d[0] for d in docs], "tk": [0] * len(docs), "bytes": [d[1] for d in docs]})
    spans = pa.Table.from_batches(list(substrings.find_spans(iter([batch]), substrings.Hot(np.zeros(0, np.uint64))))).to_pylist()
    cover = {i: np.zeros(len(t), bool) for i, t in docs}
    cut = []
    for s in spans:
        p, s1 = s["s0"] + (s["shape"] >> 9), s["s0"] + (s["shape"] >> 2 & 127)
        if s["shape"] & 1:
            cover[s["did"]][s["s0"] : s1 + substrings.WIDTH] = True
        else:
            cut.append({"h": s["h"], "hot": False, "did": s["did"], "tk": 0, "p": p, "s0": s["s0"], "s1": s1, "span": data[s["did"]][s["s0"] : s1 + substrings.WIDTH]})
    cut = pa.Table.from_pylist(sorted(cut, key=lambda c: c["h"]), substrings.CUT_ARROW).to_batches(max_chunksize=5)
    seen = set()
    for r in sorted((r for b in substrings.sort_spans(iter(cut)) for r in b.to_pylist()), key=lambda r: (r["did"], r["start"])):
        if r["w1"] is None or (r["w1"], r["w2"]) in seen:
            cover[r["did"]][r["start"] : r["end"]] = True
        elif r["w1"] is not None:
            seen.add((r["w1"], r["w2"]))
    return {i: int(c.sum()) for i, c in cover.items()}


def test_repeats_in_one_long_text_and_odd_rows(spark, odd, empty):
    got = removed(spark, [(1, "long text " * 20000), (2, None)])
    assert got == brute_force([(1, b"long text " * 20000), (2, b"")])
    rows = substrings.digests(substrings.remove_repeats(odd)).collect()
    assert len(rows) == len(ODD) and all(r.n_removed == 0 for r in rows if r.doc_id in (1, 2, 3, 4))
    assert substrings.remove_repeats(empty).count() == 0


def test_suffix_order_is_the_order_of_bytes():
    dice = np.random.default_rng(2)
    data = dice.integers(97, 99, 3000).astype(np.uint8)
    start = dice.integers(0, 2900, 500)
    length = np.full(500, 100)
    order = substrings.suffix_order(substrings.Hashes(data), data, start, length)
    got = [data[s : s + 100].tobytes() for s in start[order]]
    assert got == sorted(got)


# 4 decontamination


def slow_hits(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, ids = words(text), set(), set()
    for item, t in items:
        x = words(t)
        n = min(len(x), 13)
        for k in range(len(x) - n + 1 if n else 0):
            for at in range(len(w) - n + 1):
                if w[at : at + n] == x[k : k + n]:
                    hit |= set(range(at, at + n))
                    ids |= {str(item)} if item is not None else set()
    return len(w), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(w)


def test_contamination_equals_brute_force(spark, empty):
    dice = random.Random(9)
    vocabulary = ["Alpha", "b", "É", "éta", "d1", "ΣΑΣ", "f", "g"]
    say = lambda n: " ".join(dice.choice(vocabulary) for _ in range(n))
    items = [(k, say(dice.randint(13, 30))) for k in range(8)] + [(20, "Alpha b É"), (21, "solo!"), (22, ""), (23, None), (3, say(20)), (None, say(15))]
    rows = [(k, say(dice.randint(0, 40)) + ". " + (dice.choice(items)[1] or "").upper()[: dice.randint(0, 200)] + " " + say(dice.randint(0, 60)) + (" SOLO" if k % 5 == 0 else "")) for k in range(80)]
    rows += [(k + 200, (t or "") + " tail") for k, t in items if k is not None] + [(900, None), (901, "")]
    rows = list({i: (i, t) for i, t in rows}.values())
    found = contamination.contamination(frame(spark, rows), frame(spark, items, "item_id long, text string")).collect()
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in found}
    assert got == {i: slow_hits(t, items) for i, t in rows}
    stay = contamination.clean(frame(spark, rows).withColumns({"_id": F.lit(7), "id": F.lit(8), "n": F.lit(9)}), frame(spark, items, "item_id long, text string"))
    assert {tuple(r) for r in stay.collect()} == {(i, t, 7, 8, 9) for i, t in rows if not got[i][3]}
    kept = contamination.contamination(frame(spark, ODD).withColumns({"_id": F.lit(7), "tk": F.lit(8), "h": F.lit(9)}), frame(spark, items, "item_id long, text string"), keep=["_id", "tk", "h"])
    assert [tuple(r[:3]) for r in kept.collect()] == [(7, 8, 9)] * len(ODD)
    none = contamination.contamination(frame(spark, ODD), frame(spark, [], "item_id long, text string")).collect()
    assert len(none) == len(ODD) and not any(r.n_hit for r in none)
    assert contamination.contamination(empty, frame(spark, items, "item_id long, text string")).count() == 0


# 6 near-duplicates


def test_signatures_estimate_weighted_jaccard():
    dice = np.random.default_rng(4)
    for size in (6, 300, 5000):
        x = dice.integers(0, 1 << 63, size).astype(np.uint64)
        w = dice.integers(1, 4, size).astype(float)
        v = np.where(dice.random(size) < 0.2, w + 2, w)
        want = np.minimum(w, v).sum() / np.maximum(w, v).sum()
        same = np.mean(dartminhash.signature(x, w, 2000) == dartminhash.signature(x, v, 2000))
        assert same == pytest.approx(want, abs=0.05)


@pytest.mark.parametrize("rounds", [0, 8])
def test_classes_equal_brute_force(spark, odd, empty, monkeypatch, rounds):
    monkeypatch.setattr(dartminhash, "LEADER_ROUNDS", rounds)
    monkeypatch.setattr(dartminhash, "BLOCK", 2)
    dice = random.Random(6)
    word = lambda: "".join(dice.choice("abcdefgh") for _ in range(5))
    rows, texts = [], [[word() for _ in range(60)] for _ in range(12)]
    for t in texts:
        for k in range(dice.randint(1, 8)):
            t = list(t)
            if k % 3:
                t[dice.randint(0, 59)] = word()
            rows.append((len(rows), " ".join(t)))
    got = {r.doc_id: r.class_id for r in dartminhash.classes(frame(spark, rows), weighted=False).collect()}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(56)} for i, t in rows}
    want = {i: i for i in sets}
    for _ in rows:
        for a in sets:
            for b in sets:
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    want[a] = want[b] = min(want[a], want[b])
    assert got == want
    if not rounds:
        return
    out = dartminhash.representatives(odd.withColumns({c: F.lit(f"my {c}") for c in ("id", "_id", "_tk", "_row", "class_id", "first", "node")})).collect()
    assert len(out) == len(ODD) - 1 and {tuple(r[2:]) for r in out} == {("my id", "my _id", "my _tk", "my _row", "my class_id", "my first", "my node")}
    kept = dartminhash.classes(odd.withColumns({"_id": F.lit(7), "_tk": F.lit(8)}), keep=["_id", "_tk"]).collect()
    assert [tuple(r[:2]) for r in kept] == [(7, 8)] * len(ODD)
    with pytest.raises(ValueError):
        dartminhash.classes(odd.withColumn("class_id", F.lit(1)), keep=["doc_id", "class_id"])
    assert dartminhash.representatives(empty).count() == 0


@pytest.mark.parametrize("doubt", [4.5, None])
def test_weighted_classes_equal_brute_force(spark, monkeypatch, doubt):
    monkeypatch.setattr(dartminhash, "LEADER_ROUNDS", 0 if doubt is None else 8)
    monkeypatch.setattr(dartminhash, "DOUBT", doubt)
    dice = random.Random(16)
    rows = []
    for _ in range(14):
        line, more = (" ".join("".join(dice.choice("abcdefgh") for _ in range(5)) for _ in range(n)) for n in (12, 30))
        for _ in range(dice.randint(2, 6)):
            rows.append((len(rows), " ".join([line] * dice.randint(1, 6) + [more])))
    bags = {i: Counter(tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)) for i, t in rows}
    want = {i: i for i in bags}
    for _ in rows:
        for a in bags:
            for b in bags:
                if (bags[a] & bags[b]).total() >= 0.8 * (bags[a] | bags[b]).total():
                    want[a] = want[b] = min(want[a], want[b])
    got = {r.doc_id: r.class_id for r in dartminhash.classes(frame(spark, rows)).collect()}
    assert got == want and len(set(want.values())) > 14
    assert {r.doc_id for r in dartminhash.representatives(frame(spark, rows)).collect()} == set(want.values())


def test_all_of_the_smallest_table_by_brute_force(spark):
    from kerbside.llm import catalog

    bags = {}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        w = (r.text or "").lower().encode().split()
        bags[r.doc_id] = Counter(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))) if w else Counter()
    links = [(a, b) for a in bags for b in bags if a < b and bags[a] and bags[b] and min(bags[a].total(), bags[b].total()) >= 0.8 * max(bags[a].total(), bags[b].total()) and (bags[a] & bags[b]).total() >= 0.8 * (bags[a] | bags[b]).total()]
    want = {i: i for i in bags}
    for _ in bags:
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    assert {r.doc_id: r.class_id for r in catalog.op6_dartminhash(spark, "/root/testdata/sf0.001").collect()} == want and links


@pytest.mark.parametrize("most", [1 << 22, 1 << 10])
def test_a_group_of_near_copies_is_told_by_a_forest(spark, monkeypatch, most):
    monkeypatch.setattr(dartminhash, "LEADER_ROUNDS", 0)
    monkeypatch.setattr(dartminhash, "TASK_BYTES", most)
    # Copies k and k + 1 of a text have 89 of 101 shingles in common, k and k + 2 only 79 of 111; all are one class.
    words = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(words[6 * k : 6 * k + 99])) for k in range(30)]
    got = {r.doc_id: r.class_id for r in dartminhash.classes(frame(spark, rows)).collect()}
    assert set(got.values()) == {0} and len(got) == 30
    # However many of its pairs are alike, a task of n nodes tells n - 1 links.
    made = np.array([dartminhash.packed(np.arange(i, i + 50, dtype=np.uint64), np.ones(1, np.int64)) for i in range(20)], object)
    near = [np.setdiff1d(np.arange(20), [k]) for k in range(20)]
    a, b = dartminhash.forest(list(made), np.arange(20), np.arange(20), near, 0.8)
    assert len(a) == 19 and all(abs(i - j) <= 5 for i, j in zip(a, b, strict=True))


def test_wordless_rows_without_an_id_all_stay(spark):
    rows = [(None, None, "a"), (None, "", "b"), (None, "", "b"), (None, "  ", "a"), (1, None, "a"), (1, "x y", "a"), (1, "x y", "b")]
    out = dartminhash.representatives(frame(spark, rows, "doc_id long, text string, source string")).collect()
    assert len(out) == 5 and {tuple(r) for r in out} >= {rows[0], rows[1], rows[3], rows[4]}


# 7 URL lists


def test_url_filter_judges_by_the_day(spark):
    day = lambda d: f"2024-{d} 00:00:00"
    pages = [(1, "http://Ads.Example.com:80/x", day("01-05")), (2, "http://ads.example.com/x", day("02-05")), (3, "https://u:p@www.example.com", day("03-01")), (4, "http://example.com", day("01-01")), (5, None, day("01-01")), (6, "nonsense", day("01-01")), (7, "http://example.com", None), (2, "http://ads.example.com/x", day("02-05"))]
    entries = [("ads.example.com", "block", day("01-05")), ("ads.example.com", "allow", day("02-05")), ("example.com", "block", day("03-01")), (None, "block", day("01-01"))]
    make = lambda rows, names: spark.createDataFrame(rows, names)
    lists = make(entries, "name string, action string, listed_at string")
    got = urls.judge(make(pages, "page_id int, url string, fetched_at string"), lists).collect()
    assert sorted((r.page_id, r.kept, r.entry) for r in got if r.page_id != 2) == [(1, False, "ads.example.com"), (3, False, "example.com"), (4, True, None), (5, True, None), (6, True, None), (7, True, None)]
    assert [(r.kept, r.action) for r in got if r.page_id == 2] == [(True, "allow")] * 2
    assert all(r.kept for r in urls.judge(make(pages, "page_id int, url string, fetched_at string"), lists.limit(0)).collect())


def test_hosts_and_ties(spark, empty):
    day = "2024-01-05 00:00:00"
    hosts = {"http://a@b@bad.com/x": "bad.com", "http://Bad.com./": "bad.com", "http://[2001:db8::1]:80/x": "[2001:db8::1]", "http://10.0.0.1/": "10.0.0.1", "http://u:p@sub.bad.com:8080?q@r": "sub.bad.com", "http:///x": None, "//bad.com": None, "http://bad.com/a@good.com": "bad.com", "http://...": None, "http://" + "a." * 5000 + "bad.com": "a." * 5000 + "bad.com"}
    rows = frame(spark, [(k, u) for k, u in enumerate(hosts)], "k int, url string").select("k", "url", urls.host_of(F.col("url")).alias("h")).collect()
    assert {r.url: r.h for r in rows} == hosts
    lists = frame(spark, [("BAD.com.", "block", day), ("bad.com", "permit", day), ("10.0.0.1", "block", day), ("0.0.1", "block", day), ("com", "allow", day)], "name string, action string, listed_at string")
    pages = frame(spark, [(u, "2024-02-01 00:00:00") for u in [*hosts, "http://10.9.0.0.1/", "http://10.8.0.1/", "http://x.com"]], "url string, fetched_at string")
    got = {r.url: (r.kept, r.entry) for r in urls.judge(pages, lists).collect()}
    assert got["http://a@b@bad.com/x"] == got["http://Bad.com./"] == got["http://u:p@sub.bad.com:8080?q@r"] == (False, "bad.com")
    assert got["http://10.0.0.1/"] == (False, "10.0.0.1") and got["http://10.8.0.1/"] == (True, None) and got["http://x.com"] == (True, "com")
    assert urls.judge(pages.limit(0), lists).count() == 0
    with pytest.raises(ValueError):
        urls.judge(pages.withColumn("hit", F.lit(1)), lists)


# 8 language, 9 toxicity


def test_languages_are_told_apart_on_held_out_rows(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = language.train(docs.where(~held))
    rows = language.predict(docs.where(held), model, keep=["lang"]).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.9 and all(0 <= r.score <= 1 for r in rows)
    got = {r.doc_id: r for r in language.predict(odd, model).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[7].lang_pred == "und" and got[1].score == 0 and got[3].lang_pred in model.languages
    assert {r.lang_pred for r in language.predict(odd, language.fit([])).collect()} == {"und"}


def test_a_copied_text_counts_once_in_the_sample(spark):
    hash_of = lambda t: spark.range(1).select(F.xxhash64(F.lit("language"), F.lit(t))).first()[0]
    copied = min((f"the words of page {k}" for k in range(30)), key=hash_of)
    others = [t for t in (f"die worte der seite {k}" for k in range(30)) if hash_of(t) > hash_of(copied)][:10]
    model = language.train(frame(spark, [(copied, "en")] * 50 + [(t, "de") for t in others], "text string, lang string"), rows=8)
    assert model.languages == ["de", "en"]


def test_chain_finds_toxic_rows_it_has_not_seen():
    dice = random.Random(8)
    clean = ["".join(dice.choice("aeioubcd") for _ in range(4)) for _ in range(80)]
    rows, labels = [], []
    for k in range(600):
        words = [dice.choice(clean) for _ in range(40)]
        if k % 6 == 0:
            words[dice.randint(0, 39)] = dice.choice(["villainous", "villainy", "wretch"])
        rows.append(" ".join(words))
        labels.append([k % 2, float(k % 6 == 0)])
    cache = {}
    chain = toxicity.fit(["other", "toxic"], [toxicity.features(t, cache) for t in rows[:400]], np.array(labels[:400], float), np.array([zlib.crc32(str(k).encode()) % toxicity.FOLDS for k in range(400)]))
    got = [chain.probabilities(t)[1] >= chain.thresholds[1] for t in rows[400:]]
    assert np.mean([g == bool(y[1]) for g, y in zip(got, labels[400:], strict=True)]) > 0.97


def test_chain_on_held_out_labels(spark):
    """Precision and recall on labelled documents that training does not see."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    chain = toxicity.train(docs, labels.where(~held).select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic"), ["low_quality", "toxic"])
    rows = toxicity.score(docs.join(labels.where(held), "doc_id"), chain, keep=["doc_id", "toxic"]).collect()
    hit = sum(r.is_toxic and r.toxic == 1 for r in rows)
    precision, recall = hit / max(sum(r.is_toxic for r in rows), 1), hit / sum(r.toxic == 1 for r in rows)
    print(f"toxic, held out: {len(rows)} rows, precision {precision:.3f}, recall {recall:.3f}")
    assert precision > 0.85 and recall > 0.75


def test_the_sample_is_bounded_and_keeps_repeated_rows(spark, monkeypatch):
    docs = frame(spark, [(k % 10, f"word{k % 3} other") for k in range(300)])
    labels = frame(spark, [(k, k % 2) for k in range(10)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda categories, rows, labelled, folds: seen.append(len(rows)))
    toxicity.train(docs, labels, ["toxic"], rows=20)
    toxicity.train(docs, labels, ["toxic"], rows=1000)
    assert seen == [20, 300]


def test_a_score_at_its_threshold_is_toxic(spark):
    chain = toxicity.Chain(["toxic"], [toxicity.Linear(np.zeros(toxicity.BUCKETS + 1, np.float32))], [0.5])
    rows = toxicity.score(frame(spark, [(1, "any"), (1, "any"), (2, None)]), chain).collect()
    assert [(r.p_toxic, r.is_toxic) for r in rows] == [(0.5, True)] * 3


def test_chain_without_labels_rejects_nothing(spark, odd, empty):
    chain = toxicity.train(odd, frame(spark, [], "doc_id long, toxic int"), ["toxic"])
    assert not any(r.is_toxic for r in toxicity.score(odd, chain).collect())
    assert toxicity.score(empty, chain).count() == 0


def test_pipeline_on_the_smallest_tables(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sf, kept = "/root/testdata/sf0.001", {}
    for name, step in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.stage(step(spark, docs, sf), name)
        if name != "byte_bpe":
            assert docs.columns == before.columns
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    ids = list(kept.values())
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False)) and ids[2] == ids[3] == ids[4]
    assert docs.where("NOT intact").count() == 0
    texts = {r.doc_id: r.text for r in before.collect()}
    assert not any(secrets.base_spans(t or "") for t in texts.values())
    assert len({hashlib.sha256((t or "").encode()).digest() for t in texts.values()}) == len(texts)


def test_reading_a_large_column_leaves_no_direct_buffers(spark):
    """A row group's column used to stay in a buffer beside the heap, one for each thread that read one."""
    beans = spark.sparkContext._jvm.java.lang
    kind = beans.Class.forName("java.lang.management.BufferPoolMXBean")

    def direct():
        return sum(p.getMemoryUsed() for p in beans.management.ManagementFactory.getPlatformMXBeans(kind) if p.getName() == "direct")

    digest = lambda k: F.unhex(F.sha2(F.concat("id", F.lit(k)).cast("string"), 512))
    table = common.stage(spark.range(4000).repartition(1).select(F.concat(*map(digest, range(160))).alias("whole")), "large")
    before = direct()
    assert table.where(F.length("whole") == 160 * 64).agg(F.max("whole").isNotNull(), F.count("*")).first()[1] == 4000
    assert direct() - before < 8 << 20


def test_a_session_may_still_read_ranges_at_once(spark):
    own = spark.newSession()
    own.conf.set(common.RANGES_AT_ONCE, "true")
    common.read_in_turn(own)
    assert own.conf.get(common.RANGES_AT_ONCE) == "true"
    other = spark.newSession()
    common.read_in_turn(other)
    assert other.conf.get(common.RANGES_AT_ONCE) == "false"
