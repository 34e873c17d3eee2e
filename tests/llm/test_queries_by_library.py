"""Whole queries against the tokenizers library, which would show if an operator were broken."""

import zlib

import duckdb
import numpy as np
import pytest

from changewatch.llm import queries as Q
from conftest import SF


@pytest.fixture(scope="module")
def documents():
    return dict(duckdb.execute(f"select doc_id, text from read_parquet('{SF}/documents.parquet')").fetchall())


def test_token_counts_of_the_query_equal_the_library(spark, documents):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(Q.vocabulary())
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in Q.op5_token_counts(spark, SF).collect()}
    assert got.keys() == documents.keys()
    for i, text in documents.items():
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert got[i] == (len((text or "").encode()), n, n > 512)


def test_packed_pieces_of_the_query_hold_every_token_once(spark, documents):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(Q.vocabulary())
    pieces, places = {}, {}
    for r in Q.op1_packing(spark, SF).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, text in documents.items():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], dtype="<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for found in places.values():
        upto = 0
        for offset, length in sorted(found):
            assert offset == upto
            upto += length
        assert upto <= 2048
