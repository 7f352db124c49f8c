"""Whole queries against the libraries they stand for, on the smallest tables."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from kerbside.llm import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    return [(r.doc_id, r.text or "") for r in rows]


def test_op10_equals_tiktoken(spark, texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(catalog.RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for doc, text in texts:
        ids = library.encode_ordinary(text)
        want[doc] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in catalog.op10_bytebpe(spark, SF).collect()}
    assert got == want and len(got) == len(texts)


def test_op5_equals_tokenizers(spark, texts):
    library, start, want = Tokenizer.from_file(catalog.WORD_VOCABULARY), 0, {}
    for doc, text in texts:
        ids = [*library.encode(text, add_special_tokens=False).ids, catalog.END_ID]
        want[doc] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in catalog.op5_wavelet(spark, SF).collect()}
    assert got == want and len(got) == len(texts)
