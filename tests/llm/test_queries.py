"""The registered queries over the smallest tables; digests against the libraries that define them."""

from __future__ import annotations

import hashlib
import os
import zlib

import numpy as np
import pytest

queries = pytest.importorskip("assetlode.llm.queries")

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in queries.documents(spark, SF).select("doc_id", "text").collect()}


def encoded(name, texts):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(queries.tokenizer(name))
    own.no_truncation()
    own.no_padding()
    return own, {i: own.encode(t, add_special_tokens=False).ids for i, t in texts.items()}


def test_op2_pieces(spark, texts):
    _, ids = encoded("word_bpe_49k.json", texts)
    rows = queries.op2_packing(spark, SF).collect()
    covered = {i: 0 for i in texts}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        own = [*ids[r.doc_id], 1]
        assert r.start == covered[r.doc_id] and r.doc_tokens == len(own) and r.offset + r.length <= 2048
        covered[r.doc_id] += r.length
        assert r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], dtype="<u4").tobytes())
    assert all(covered[i] == len(ids[i]) + 1 for i in texts)
    places = sorted((r.sequence_id * 2048 + r.offset, r.length) for r in rows)
    assert [p for p, _ in places] == np.cumsum([0, *(n for _, n in places[:-1])]).tolist()


def test_op5_digests(spark, texts):
    own, ids = encoded("byte_bpe_50k.json", texts)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = queries.op5_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = ids[r.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want), sha(",".join(map(str, want))), sha(own.decode(want, skip_special_tokens=False)))


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - {"op2_packing", "op5_bpe"}))
def test_each_query_returns_every_row(spark, texts, name):
    frame = queries.queries()[name](spark, SF)
    key = "page_id" if "page_id" in frame.columns else "doc_id"
    found = [r[key] for r in frame.select(key).collect()]
    assert len(found) == len(set(found)) == (queries.pages(spark, SF).count() if key == "page_id" else len(texts))
