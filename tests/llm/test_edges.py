"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import base64
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from cubeweave.llm import archives, classifier, extraction, line_dedup, media, mixing, near_duplicates, packing, quality_rules, tokens

LONG = "lorem ipsum dolor sit amet consectetur " * 4000
LINE = "one two three four five six seven eight nine ten eleven twelve"
ROWS = [
    (1, f"{LINE}\nanother line of some seven words here", "en", "a", 10),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, LONG, "en", None, 9),
    (1, f"{LINE}\nanother line of some seven words here", "en", "a", 10),
    (None, "a text that has no number at all but words enough", "de", "b", 1),
    (5, f"{LINE}\nanother line of some seven words here", "en", "a", 10),
    (6, " \t\n \x0b", "en", "a", 4),
    (7, "日本語のテキストです。" * 30, "ja", "b", 4),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ["id", "node", "key", "words", "votes", "length", "start", "part", "comp", "rate", "digest", "line", "n_removed", "mix_key", "quality", "keys", "at", "th", "pos"]


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    for c in EXTRA:
        frame = frame.withColumn(c, F.lit("clash"))
    return frame


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a/b c", "<article><p>x</p></article>"), (2, None, None), (3, "", ""), (4, "u", "<article><p>x</p></article>"), (4, "u", "<article><p>x</p></article>"), (5, "v", "<p>" + "word " * 30000)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    for c in ("id", "payload", "value", "page", "text", "rid"):
        frame = frame.withColumn(c, F.lit("clash"))
    return frame


def ordered(frame):
    return sorted((r.asDict() for r in frame.collect()), key=str)


def test_tokens(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.vocabulary_path())
    out = tokens.prefix_counts(docs, store=True).collect()
    assert len(out) == len(ROWS)
    texts = {(r[0], len((r[1] or "").encode())): r[1] or "" for r in ROWS}
    for r in out:
        text = texts[r["doc_id"], r["n_bytes"]]
        assert r["n_tokens"] == len(tok.encode(text, add_special_tokens=False).ids)
        assert r["over_limit"] == (r["n_tokens"] > 2048)
        import numpy as np

        steps = np.frombuffer(r["prefix_steps"], "<i2")
        assert len(steps) == len(text) and tokens.count_at(steps, len(text)) == r["n_tokens"]
        for n in (1, 7, len(text) // 2):
            assert tokens.count_at(steps, n) == len(tok.encode(text[:n], add_special_tokens=False).ids)
    assert tokens.prefix_counts(docs.limit(0)).count() == 0


def test_packing(docs):
    out = packing.pack(docs, with_ids=True).collect()
    assert len({r["sequence_id"] for r in out}) == len(out) and min(r["sequence_id"] for r in out) == 0 and max(r["sequence_id"] for r in out) == len(out) - 1
    assert all(r["length"] & (r["length"] - 1) == 0 and r["length"] <= 2048 and r["offset"] == 0 for r in out)
    assert sum(r["length"] for r in out if r["doc_id"] == 1) == 2 * next(r["doc_tokens"] for r in out if r["doc_id"] == 1)
    assert [(r["length"], r["doc_tokens"]) for r in out if r["doc_id"] in (2, 3)] == [(1, 1), (1, 1)]
    for r in out:
        assert zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in r["ids"])) == r["ids_crc32"]
    by = {}
    for r in sorted(out, key=lambda r: r["sequence_id"]):
        by.setdefault(r["length"], []).append(r["sequence_id"])
    assert all(s == list(range(s[0], s[0] + len(s))) for s in by.values())
    assert packing.pack(docs.limit(0)).count() == 0


def test_queries_write_ids_and_prefix_counts(spark, tmp_path):
    import corpus_pipeline
    import numpy as np

    from cubeweave.llm import queries

    frame = spark.createDataFrame(ROWS, SCHEMA)
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    for r in queries.op8_token_counts(spark, str(tmp_path)).collect():
        assert tokens.count_at(np.frombuffer(r["prefix_steps"], "<i2"), len(r["prefix_steps"]) // 2) == r["n_tokens"]
    for out in (queries.op10_packing(spark, str(tmp_path)), corpus_pipeline.packing_stage(spark, frame, str(tmp_path))):
        for r in out.collect():
            assert len(r["ids"]) == r["length"] and zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in r["ids"])) == r["ids_crc32"]


def test_piece_lengths():
    for n in (1, 2047, 2048, 2049, 10_000):
        parts = packing.piece_lengths(n, 2048)
        assert sum(parts) == n and all(p & (p - 1) == 0 for p in parts)
    with pytest.raises(ValueError):
        packing.pack(None, longest=1000)


def test_media(docs):
    out = media.media_columns(docs).collect()
    assert len(out) == len(ROWS)
    for r in out:
        assert r["payload_bytes"] % 192 == 0 and r["payload_bytes"] > 0 and r["media_bytes"] == r["payload_bytes"] + 44
    empty = [r for r in out if r["doc_id"] in (2, 3)]
    assert {r["payload_sha256"] for r in empty} == {hashlib.sha256(b" " * 192).hexdigest()} and {r["tail_crc32"] for r in empty} == {zlib.crc32(b" " * 16)}
    assert len({r["media_sha256"] for r in out if r["doc_id"] in (1, 5)}) == 1
    assert media.media_columns(docs.limit(0)).count() == 0


def test_media_store_keeps_each_chunk_once(spark, tmp_path):
    import random

    r = random.Random(3)
    shared = "".join(r.choices("abcdefgh ", k=30_000))
    texts = [(k, "".join(r.choices("mnopqrs ", k=5000)) + shared + "".join(r.choices("uvwxyz ", k=5000))) for k in range(6)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    lists = media.chunk_lists(frame)
    path = str(tmp_path / "store")
    media.write_store(frame, media.shared_chunks(lists), path)
    stored = spark.read.schema(media.STORE_SCHEMA).parquet(path)
    held = stored.select(F.explode(F.concat("own", "shared")).alias("c")).select(F.sha2("c.bytes", 256).alias("d")).collect()
    assert len(held) == len({h["d"] for h in held})
    assert len(held) == lists.select(F.explode("digests").alias("d")).distinct().count()
    assert stored.agg(F.sum(F.size("refs"))).first()[0] > 50
    back = media.read_streams(stored).collect()
    assert {r["payload_sha256"] for r in back} == {hashlib.sha256(media.payload(t.encode())).hexdigest() for _, t in texts}


def test_cuts_follow_content():
    import random

    data = bytes(random.Random(5).choices(range(256), k=60_000))
    ends = media.cuts(data)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert ends[-1] == len(data) and max(sizes) <= media.MOST_CHUNK and min(sizes[:-1]) >= media.LEAST_CHUNK
    moved = {data[a:b] for a, b in zip([0, *ends], ends)} & (lambda e, d: {d[a:b] for a, b in zip([0, *e], e)})(media.cuts(b"x" * 777 + data), b"x" * 777 + data)
    assert len(moved) > 0.8 * len(ends)


def test_quality_rules_against_plain_python(docs):
    out = quality_rules.score(docs).collect()
    assert len(out) == len(ROWS)
    texts = {}
    for d, t, *_ in ROWS:
        texts.setdefault(d, []).append(t or "")
    for r in out:
        t = next(x for x in texts[r["doc_id"]])
        words = t.encode().split()
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        seen = {}
        for w in windows:
            seen[w] = seen.get(w, 0) + 1
        held = {k + j for k, w in enumerate(windows) if seen[w] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(held))
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.score(docs.limit(0)).count() == 0


def test_label_model_trusts_agreeing_rules():
    n = len(quality_rules.RULES)
    patterns = {"+" * n: 900, "+" * (n - 3) + "---": 60, "+" * (n - 1) + "-": 40}
    model = quality_rules.fit(patterns)
    assert model.posterior("+" * n) > 0.99 and model.posterior("+" * (n - 3) + "---") < 0.1
    assert quality_rules.fit({}).posterior("0" * n) == pytest.approx(0.8)


def test_classifier(spark, docs):
    import random

    r = random.Random(1)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(900):
        ws = r.choices(words, k=60)
        kind = k % 3
        if kind == 0:
            ws = [w + "%%%" for w in ws]
        if kind == 1:
            ws[7], ws[30] = "nasty", "awful"
        rows.append((k, " ".join(ws), int(kind != 0), int(kind == 1)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    labels = frame.where("doc_id < 600").select("doc_id", "quality", "toxic")
    out = {x["doc_id"]: x for x in classifier.classify(frame.select("doc_id", "text"), labels).collect()}
    right = sum(out[k]["kept"] == (k % 3 == 2) for k in range(600, 900))
    assert right >= 285
    assert all(out[k]["p_above_0"] >= out[k]["p_above_1"] for k in out)
    untrained = classifier.classify(docs, labels.limit(0)).collect()
    assert len(untrained) == len(ROWS)
    assert classifier.classify(docs.limit(0), labels).count() == 0


def test_near_duplicates(spark, docs):
    out = near_duplicates.near_duplicate_classes(docs).collect()
    assert len(out) == len(ROWS)
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], set()).add(r["class_id"])
    assert by[1] == by[5] == {1} and by[2] == {2} and by[3] == {3} and by[4] == {4}
    kept = sorted(str(r["doc_id"]) for r in near_duplicates.keep_one(docs).collect())
    assert kept.count("1") == 1 and "5" not in kept and "2" in kept and "4" in kept
    assert near_duplicates.near_duplicate_classes(docs.limit(0)).count() == 0


def test_near_duplicates_against_all_pairs(spark):
    import random

    r = random.Random(9)
    words = [f"w{k}" for k in range(400)]
    base = [r.choices(words, k=200) for _ in range(12)]
    texts = []
    for b in base:
        texts.append(b)
        for _ in range(6):
            c = list(b)
            for _ in range(r.choice((1, 2, 3, 9))):
                c[r.randrange(len(c))] = r.choice(words)
            texts.append(c)
    texts = [" ".join(t) for t in texts]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["class_id"] for x in near_duplicates.near_duplicate_classes(frame).collect()}
    sets = [{tuple(t.split()[k : k + 5]) for k in range(196)} for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            sim = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            if sim >= 0.83:
                assert got[i] == got[j], sim
            if i // 7 != j // 7:
                assert got[i] != got[j]


def test_keep_one_keeps_a_document_of_each_class(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(200)) for c in "ab")
    near = lambda t: t + " more"
    rows = [
        (None, "a unique text that has no number at all"), (None, "a second unique text without a number"),
        (1, a), (1, b), (2, near(a)), (3, near(b)), (None, near(near(a))),
        (4, "one id twice, the first text"), (4, "one id twice, another text altogether"), (4, "one id twice, the first text"),
        (None, "copies with no number"), (None, "copies with no number"), (None, None), (5, None), (6, ""), (7, ""),
    ]
    got = near_duplicates.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    gone = [(2, near(a)), (3, near(b)), (None, near(near(a))), rows[9], rows[10], (7, "")]
    want = list(rows)
    for g in gone:
        want.remove(g)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_block_linker_finds_what_pairs_do():
    import numpy as np
    import pyarrow as pa
    import zstandard

    class Plain:
        value = near_duplicates.Weights(np.zeros(1 << near_duplicates.SKETCH_BITS, np.int64), 10)

    base = [f"w{k}" for k in range(120)]
    texts = [" ".join(base), " ".join(base[:-1] + ["z"]), " ".join(base[::-1]), " ".join(["q", *base[1:]])]
    squeeze = zstandard.ZstdCompressor().compress
    table = pa.table({"node": pa.array([bytes([k]) for k in range(4)]), "comp": pa.array([bytes([k]) for k in range(4)]), "text": pa.array([squeeze(t.encode()) for t in texts])})
    out = near_duplicates.block_linker(Plain, 0.8)((), table).to_pydict()
    assert {frozenset(p) for p in zip(out["u"], out["v"])} == {frozenset((b"\0", b"\1")), frozenset((b"\0", b"\3"))}


def test_line_dedup(docs):
    out = line_dedup.dedup_lines(docs)
    assert set(out.columns) == {*docs.columns, "n_lines", "n_removed"}
    rows = out.collect()
    assert len(rows) == len(ROWS)
    assert [r["text"] for r in rows if r["doc_id"] == 1] == [ROWS[0][1]] * 2
    (five,) = [r for r in rows if r["doc_id"] == 5]
    assert five["text"] == "" and five["n_removed"] == 2
    (null,) = [r for r in rows if r["doc_id"] == 2]
    assert null["text"] is None and null["n_lines"] == 0
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_line_dedup_near_lines(spark):
    a = "the quick brown fox jumps over the lazy dog while the small grey cat looks on from the garden wall without a word"
    rows = [(1, f"{a}\nshort one"), (2, f"short one\n{a.replace('garden', 'garten')}\nentirely different line of words that nobody else has"), (3, a + "\n" + a)]
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: rows[0][1], 2: "short one\nentirely different line of words that nobody else has", 3: ""}


def test_line_dedup_against_all_pairs_with_long_words(spark):
    import random

    r = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    lines = []
    for family in range(20):
        # Five to eight words of 5 to 120 characters: an edit at each word's start changes few of all shingles.
        words = ["".join(r.choices(letters, k=(120, 90, 60, 40, 5)[family % 5])) for _ in range(5 + family % 4)]
        lines.append(" ".join(words))
        lines.append(" ".join("#" + w[1:] for w in words))
        one = r.randrange(len(words))
        lines.append(" ".join("+" + w[1:] if k == one else w for k, w in enumerate(words)))
    sets = [{t[k : k + 8] for k in range(max(1, len(t) - 7))} for t in lines]
    comp = list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                comp = [comp[j] if c == comp[i] else c for c in comp]
    out = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()
    firsts = {c: comp.index(c) for c in comp}
    assert len(firsts) < 40
    assert {x["doc_id"] for x in out if x["n_removed"] == 0} == set(firsts.values())


def test_line_dedup_of_lines_with_few_words_or_other_white_space(spark):
    lines = [
        "one\ttwo\tthree\tfour\tfive\tsix", "https://example.org/" + "a0b1c2d3e4" * 300, "QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVo=", "All rights reserved.",
        "བོད་ཀྱི་སྐད་ཡིག་ནི་བོད་མི་རིགས་ཀྱི", "a\x0bb\x0cc d\te", "日本語の文",
    ]
    kept = ["short one", "a b c", "", "日本語"]
    rows = [(k, "\n".join(lines + kept)) for k in range(3)]
    out = {x["doc_id"]: (x["text"], x["n_removed"]) for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {0: (rows[0][1], 0), 1: ("\n".join(kept), len(lines)), 2: ("\n".join(kept), len(lines))}


def test_mixing(spark, docs):
    out = mixing.mix(docs)
    assert set(docs.columns) - {"mix_key"} <= set(out.columns)
    first = ordered(out.select("doc_id", "mix_copy", "mix_key"))
    assert first == ordered(mixing.mix(docs).select("doc_id", "mix_copy", "mix_key"))
    assert mixing.mix(docs.limit(0)).count() == 0
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") < 15_000, "big").otherwise("small").alias("source"))
    counts = {r["source"]: r["count"] for r in mixing.mix(many, {"big": 1, "small": 3}).groupBy("source").count().collect()}
    assert abs(counts["big"] - 5000) < 350 and abs(counts["small"] - 15000) < 500
    per = mixing.mix(many, {"big": 0, "small": 1}).groupBy("doc_id").count().agg(F.avg("count"), F.max("count")).first()
    assert 4.0 < per[0] < 4.2 and per[1] < 20


def test_archives(pages):
    out = archives.archive(pages).collect()
    assert len(out) == 6
    for r in out:
        if r["page_id"] in (2, 3):
            assert r["payload_digest"] == base64.b32encode(hashlib.sha1(b"").digest()).decode() and r["payload_bytes"] == 0
    kinds = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in out}
    assert kinds[1] == ("revisit", 4) and kinds[2] == ("revisit", 3) and kinds[3] == ("response", None) and kinds[4] == ("response", None)
    assert archives.archive(pages.limit(0)).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_is_read_by_declared_lengths(version):
    body = b"a\nhttp://x 0.0.0.0 20200101000000 text/html 5\n\xff\r\n\r\n"
    data = archives.arc_segment(version, [("7", "http://h/ä b", body), ("8", None, b"")])
    got = list(archives.read_arc(data + archives.arc_segment(3 - version, [("9", "u", b"z")])))
    assert [archives.split_http(r["content"])[2] for r in got] == [body, b"", b"z"]
    assert got[0]["URL"] == "http://h/%C3%A4%20b" and len(got[0]) == len(archives.ARC_COLUMNS[version]) + 1
    with pytest.raises(ValueError):
        list(archives.read_arc(data[:-30]))


def test_extraction(pages):
    out = extraction.extract(pages).collect()
    got = {r["page_id"]: r for r in out}
    assert len(out) == 6 and got[2]["text"] == "" and got[3]["n_chars"] == 0
    assert got[1]["text"] == "x" and got[5]["text"] == ("word " * 30000).strip()
    assert extraction.extract(pages.limit(0)).count() == 0


def test_extraction_on_held_out_layouts():
    maker, right, n = extraction.Maker(4242), 0, 150
    sources = [maker.page() for _ in range(n)]
    for source, text in zip(sources, extraction.main_text(sources, extraction.trained())):
        page = extraction.Page(source)
        right += text == " ".join(t for _, t in page.segments if maker.MARK in t)
    assert right >= 0.95 * n


def test_decoding_has_no_contradiction():
    import numpy as np

    page = extraction.Page("<div><div class=comments><p>nice</p><p>post</p></div><p>real text</p></div>")
    gain = np.array([3.0] * len(page.nodes))
    gain[[n.node_id for n in page.nodes if n.own[5]]] = -20.0
    assert extraction.decode(page, gain) == ["real text"]
