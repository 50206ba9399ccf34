"""Operators against the library or plain Python, on whole small tables."""

import base64
import hashlib
import zlib

import numpy as np
import pytest

from cubeweave.llm import archives, line_dedup, packing, tokens
from tests.llm.test_edges import ROWS, SCHEMA, docs, pages  # noqa: F401

SF = "/root/testdata/sf0.001"


def test_packed_ids_are_the_tokenizers(spark, docs):  # noqa: F811
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.vocabulary_path())
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = {r["doc_id"]: [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in texts.collect()}
    pieces = {}
    for r in packing.pack(texts, with_ids=True).collect():
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
    assert {d: [i for _, ids in sorted(p) for i in ids] for d, p in pieces.items()} == want


def test_payload_digests_are_of_the_html(pages):  # noqa: F811
    html = {r["page_id"]: (r["html"] or "").encode() for r in pages.select("page_id", "html").collect()}
    for r in archives.archive(pages).collect():
        own = html[r["page_id"]]
        assert r["payload_bytes"] == len(own) and r["payload_digest"] == base64.b32encode(hashlib.sha1(own).digest()).decode()


def test_missed_pairs_are_as_rare_as_stated():
    """Pairs of lines of a similarity of 0.8 or a little more, through the bands and the samples."""
    rng = np.random.default_rng(7)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz    "))
    lines = []
    while len(lines) < 4000:
        base = rng.choice(letters, 320)
        other = base.copy()
        # Each changed character is in eight shingles; four far apart leave a similarity of 0.81 about.
        at = rng.choice(np.arange(10, 310, 20), 4, replace=False)
        other[at] = "#"
        lines += ["".join(base), "".join(other)]
    hashes, limits = line_dedup.shingle_hashes(lines)
    found = line_dedup.samples(hashes, limits)
    keys = line_dedup.band_keys(found)
    met = (keys[::2] == keys[1::2]).any(axis=1)
    agree = (found[::2] == found[1::2]).sum(axis=1) >= line_dedup.LEAST_AGREEING
    sets = line_dedup.Shingles(hashes, limits)
    near = np.array([line_dedup.jaccard_reaches(sets[k], sets[k + 1], 0.8) for k in range(0, len(lines), 2)])
    plain = np.array([(lambda a, b: len(a & b) >= 0.8 * len(a | b))(*({t[i : i + 8] for i in range(len(t) - 7)} for t in lines[k : k + 2])) for k in range(0, len(lines), 2)])
    assert (near == plain).all() and near.sum() > 1500
    assert (near & ~met).sum() <= 0.005 * near.sum() and (near & met & ~agree).sum() <= 0.001 * near.sum() + 1


@pytest.mark.parametrize("texts", [[b""], [b"", b" a\n\nb ", b"<|x|> Y", "é ß".encode()]])
def test_words_of_irregular_texts(texts):
    from tokenizers import Tokenizer

    tok, known = Tokenizer.from_file(tokens.vocabulary_path()), tokens.table(tokens.vocabulary_path())
    ids, ends = known.joined_ids(texts, 1)
    for t, a, b, s in zip(texts, [0, *ends[:-1].tolist()], ends.tolist(), tokens.prefix_steps(texts, known), strict=True):
        assert ids[a:b].tolist() == [*tok.encode(t.decode(), add_special_tokens=False).ids, 1]
        assert [int(s[:n].sum()) for n in range(len(s) + 1)] == [len(tok.encode(t.decode()[:n], add_special_tokens=False).ids) for n in range(len(t.decode()) + 1)]
