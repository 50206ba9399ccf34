"""Exact token counts at every prefix of a text (op 8), and the ids behind them.

The vocabulary files are those of public tokenizers; nothing here trains one.

A text is cut at ASCII white space.  The tokenizer's normaliser turns white
space into a space and its splitter never keeps it, so the ids of a text are
the ids of its words in order.  What is known of a word is kept in a bounded
table of the Python worker; a batch only computes the words that it lacks.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from operator import sub

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "word_bpe_49k.json"
#: Words that a generation of a Python worker's table takes; beyond it the one before goes.
WORDS_KEPT = 300_000
#: Documents of one batch are handled in slices of about so many bytes.
SLICE_BYTES = 4_000_000
#: The same where words are looked up: more text holds more words alike.
WORD_SLICE_BYTES = 8_000_000
#: And where arrays of several times the text are made.
HASH_SLICE_BYTES = 1_000_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: How byte-level BPE writes each byte: printable ones as they are, the others from code point 256 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
SHOWN = {b: b for b in PRINTABLE} | {b: 256 + k for k, b in enumerate(sorted({*range(256)} - {*PRINTABLE}))}
#: Marks, letters, marks: no digits, and no apostrophe, which may begin a contraction.
SIMPLE = re.compile(r"([!-&(-/:-@\[-`{-~]*)([a-z\xdf-\xf6\xf8-\xff]+)([!-&(-/:-@\[-`{-~]*)").fullmatch
#: What special tokens begin with.
OPENING = "<|"

#: Above every rank: a merge that doesn't exist.
NEVER = 1 << 60


class PrefixProgramme:
    """Counts of a BPE with word ends at all prefixes of one piece of text.

    ``inner[i]`` is the last token of the encoding of the first i symbols when
    more follow, ``d[i]`` their count.  A token can be last only if BPE leaves it
    and its predecessor apart, and exactly one candidate passes, so
    ``d[i] = d[i - len(token)] + 1``.  The count at a prefix that ends the text
    takes a last token with the word end instead, after the same ``inner``.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.end = model["end_of_word_suffix"] or ""
        pairs = (tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"])
        self.rank = {m: r for r, m in enumerate(pairs)}
        self.shown = {b: chr(c) for b, c in SHOWN.items()}
        # Number 0 is the beginning of a piece, which any token may follow.
        self.edges: list[tuple[tuple, tuple]] = [((), ())]
        # By what a token can begin with: the numbers of the token without the word end and of the one with it, or -1.
        self.starts: dict[str, tuple[int, int]] = {}
        for token in model["vocab"]:
            edges = self.edges_of(token)
            if edges is None:
                continue
            bare = token.removesuffix(self.end) if len(token) > len(self.end) else token
            for j in range(1, len(bare)):
                self.starts.setdefault(bare[:j], (-1, -1))
            inner, ended = self.starts.get(bare, (-1, -1))
            self.starts[bare] = (len(self.edges), ended) if bare == token else (inner, len(self.edges))
            self.edges.append(edges)
        # By token: whether each other may follow it.
        self.follows: list[dict[int, bool]] = [{} for _ in self.edges]
        self.follows[0] = dict.fromkeys(range(len(self.edges)), True)
        self.known = 0
        self.last: tuple[str, list[int], list[int], list[int]] = ("", [0], [0], [0])

    def merged(self, symbols: list[str]) -> list[tuple[str, ...]]:
        """Plain BPE: merge the pair of lowest rank, leftmost first, until none is left; each token with the halves of its last merge."""
        parts: list[tuple] = [(s,) for s in symbols]
        while len(parts) > 1:
            ranks = [self.rank.get((x[0], y[0]), NEVER) for x, y in zip(parts, parts[1:])]
            low = min(ranks)
            if low == NEVER:
                break
            i = ranks.index(low)
            x, y = parts[i], parts[i + 1]
            parts[i : i + 2] = [(x[0] + y[0], x, y)]
        return parts

    def edges_of(self, token: str) -> tuple[tuple, tuple] | None:
        """The parts at a token's right edge and at its left edge, as BPE builds it, each with the rank of the merge that ends it.

        None if the vocabulary entry isn't its own encoding: it then stands in no encoding.
        """
        bare = token.removesuffix(self.end) if len(token) > len(self.end) else token
        parts = self.merged([*bare[:-1], bare[-1] + token[len(bare) :]])
        if len(parts) > 1:
            return None
        spines = []
        for side in (2, 1):
            part, spine = parts[0], [(token, NEVER)]
            while len(part) > 1:
                rank = self.rank[part[1][0], part[2][0]]
                part = part[side]
                spine.append((part[0], rank))
            spines.append(tuple(spine[::-1]))
        return spines[0], spines[1]

    def may_follow(self, before: int, token: int) -> bool:
        """Whether BPE keeps these two tokens apart, side by side.

        At their boundary stand a part of each, which grows by the merges inside
        its token.  They become one only if the merge of two such parts comes
        before both of the merges that would end these parts.
        """
        right, left, rank, i, j, apart = self.edges[before][0], self.edges[token][1], self.rank, 0, 0, True
        while True:
            (x, ends_x), (y, ends_y) = right[i], left[j]
            joins = rank.get((x, y), NEVER)
            if joins < ends_x and joins <= ends_y and joins < NEVER:
                apart = False
                break
            if ends_x == ends_y == NEVER:
                break
            if ends_x <= ends_y:
                i += 1
            else:
                j += 1
        self.known += 1
        if self.known > 1_500_000:
            self.known = 0
            for row in self.follows[1:]:
                row.clear()
        self.follows[before][token] = apart
        return apart

    def counts(self, piece: str) -> list[int] | None:
        """Counts at the prefixes of 1, 2, ... characters; None where the programme finds no last token."""
        ascii_ = piece.isascii()
        text = piece if ascii_ else "".join([self.shown[b] for b in piece.encode()])
        n, starts, follows, may_follow = len(text), self.starts.get, self.follows, self.may_follow
        # What the piece before this one has in common with it needs no second look; in sorted order that is much.
        last, inner, d, ended = self.last
        same, most = 0, min(n, len(last))
        while same < most and text[same] == last[same]:
            same += 1
        more = n - same
        inner, d, ended = inner[: same + 1] + [-1] * more, d[: same + 1] + [0] * more, ended[: same + 1] + [0] * more
        self.last = text, inner, d, ended
        for k in range(n):
            before = inner[k]
            if before < 0:
                continue
            after, one_more = follows[before].get, d[k] + 1
            for i in range((k if k > same else same) + 1, n + 1):
                found = starts(text[k:i])
                if found is None:
                    break
                a, b = found
                if a > 0 and inner[i] < 0:
                    apart = after(a)
                    if may_follow(before, a) if apart is None else apart:
                        inner[i], d[i] = a, one_more
                if b > 0 and not ended[i]:
                    apart = after(b)
                    if may_follow(before, b) if apart is None else apart:
                        ended[i] = one_more
        if ascii_:
            out = ended[1:]
        else:
            at, out = 0, []
            for c in piece:
                at += len(c.encode())
                out.append(ended[at])
        return None if 0 in out else out


class Kept(dict):
    """What is known of words: the younger of two generations.

    When it is full, it becomes the elder, whose words move back when they are wanted;
    so frequent words stay and rare ones go.
    """

    def __init__(self) -> None:
        self.elder: dict[bytes, bytes] = {}

    def lacking(self, wanted: Iterable[bytes]) -> list[bytes]:
        """Those of the words that neither generation has; the others are in the younger."""
        if len(self) >= WORDS_KEPT:
            self.elder = dict(self)
            self.clear()
        out, back = [], self.elder.pop
        for w in wanted:
            if w not in self:
                value = back(w, None)
                if value is None:
                    out.append(w)
                else:
                    self[w] = value
        return out


class WordTable:
    """The ids of words, and the steps of their counts, by word."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.path = path
        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.ids, self.steps = Kept(), Kept()
        specials = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.mark = min(specials)
        self.mark_id = self.tokenizer.token_to_id(self.mark)
        self.openings = tuple({s[:2] for s in specials})
        self.has_simple = self.openings == (OPENING,)
        self.openings_b = tuple(o.encode() for o in self.openings)
        # The splitter's own pattern, read from the file.
        with open(path, encoding="utf-8") as f:
            split = json.load(f)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(split)
        self.marks: dict[str, list[int]] = {"": []}
        self.programme: PrefixProgramme | None = None
        self.piece_counts: dict[str, list[int] | None] = {}

    def word_ids(self, words: list[str]) -> list[list[int] | np.ndarray]:
        """Ids of each word.

        Most words are letters of Latin-1 between ASCII marks.  The normaliser only
        puts these in lower case and the splitter cuts just there, so their pieces
        go straight to the model; all other words go through the whole tokenizer.
        """
        found: list = [None] * len(words)
        tokenize, marks, rest = self.tokenizer.model.tokenize, self.marks, []
        for k, w in enumerate(words):
            if w.isascii() and w.isalpha():
                found[k] = [t.id for t in tokenize(w.lower())]
                continue
            m = SIMPLE(w.lower()) if self.has_simple and OPENING not in w else None
            if m is None:
                rest.append(k)
                continue
            before, letters, after = m.groups()
            for x in (before, after):
                if x not in marks:
                    marks[x] = [t.id for t in tokenize(x)]
            if not letters.isascii():
                letters = letters.encode().decode("latin-1").translate(SHOWN)
            found[k] = marks[before] + [t.id for t in tokenize(letters)] + marks[after]
        for k, ids in zip(rest, self.encode([words[k] for k in rest]), strict=True):
            found[k] = ids
        return found

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text.  Short texts go to the library many at once, parted by a special token."""
        if not texts:
            return []
        special = [any(o in t for o in self.openings) for t in texts]
        found: list = [None] * len(texts)
        alone = [k for k, s in enumerate(special) if s]
        rest = [k for k, s in enumerate(special) if not s]
        for k, e in zip(alone, self.tokenizer.encode_batch_fast([texts[k] for k in alone], add_special_tokens=False), strict=True):
            found[k] = np.array(e.ids, self.dtype)
        for a in range(0, len(rest), 512):
            some = rest[a : a + 512]
            (e,) = self.tokenizer.encode_batch_fast([self.mark.join([texts[k] for k in some])], add_special_tokens=False)
            ids = np.array(e.ids, self.dtype)
            cuts = np.flatnonzero(ids == self.mark_id).tolist()
            for k, x, y in zip(some, [0, *(c + 1 for c in cuts)], [*cuts, len(ids)], strict=True):
                found[k] = ids[x:y]
        return found

    def lowered(self, text: bytes) -> bytes:
        """A text with its ASCII letters in lower case where that can't change the ids.

        That is not beside combining marks, and not where a special token's string
        may stand.  Both need the text as it is.
        """
        if b"\xcc" in text or b"\xcd" in text or any(o in text for o in self.openings_b):
            return text
        return text.lower()

    def coded(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """The words of all texts as numbers, where each text's end, and the distinct words by number."""
        lists = pc.ascii_split_whitespace(pa.array([self.lowered(t) for t in texts], pa.binary()).cast(pa.string()))
        found = lists.values.dictionary_encode()
        return found.indices.to_numpy(), lists.offsets.to_numpy()[1:], found.dictionary.cast(pa.binary()).to_pylist()

    def joined_ids(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, each text's closed by ``end_id``, and where each text's end."""
        codes, ends, words = self.coded(texts)
        self.learn(words)
        own = list(map(self.ids.__getitem__, words))
        flat = np.append(np.frombuffer(b"".join(own), self.dtype), np.array([end_id], self.dtype))
        n = np.append(np.fromiter(map(len, own), np.int64, len(own)) // self.dtype.itemsize, 1)
        ids, upto = gathered(flat, n, np.insert(codes, ends, len(own)))
        return ids, upto[ends + np.arange(1, len(ends) + 1)]

    def learn(self, words: Iterable[bytes]) -> None:
        """Look up the ids of all words that the table lacks."""
        lacking, kind = self.ids.lacking(words), self.dtype.char
        for w, ids in zip(lacking, self.word_ids([w.decode() for w in lacking]), strict=True):
            self.ids[w] = array(kind, ids).tobytes()

    def learn_steps(self, words: Iterable[bytes]) -> None:
        """For words that the table lacks: how the count changes with each further character, as 16-bit bytes.

        All that stands before a word ends at white space and can't change any
        more, so the count at a text's prefix is the sum of the steps up to there.
        The library's count of each whole word is compared with the programme's;
        words that differ, or whose characters the normaliser joins or splits,
        take the library's counts of all their prefixes.
        """
        if self.programme is None:
            self.programme = PrefixProgramme(self.path)
        lacking = sorted(self.steps.lacking(words))
        texts = [w.decode() for w in lacking]
        for w, t, ids in zip(lacking, texts, self.word_ids(texts), strict=True):
            counts = self.word_counts(t) if t else []
            if counts is None or t and counts[-1] != len(ids):
                counts = [len(i) for i in self.encode([t[:j] for j in range(1, len(t) + 1)])]
            self.steps[w] = array("h", map(sub, counts, [0, *counts[:-1]])).tobytes()

    def word_counts(self, word: str) -> list[int] | None:
        low = word.lower()
        if low.isascii() and low.isalpha():
            return self.programme.counts(low)
        m = SIMPLE(low) if self.has_simple and OPENING not in word else None
        if m is not None:
            before, letters, after = m.groups()
            if not before and not after:
                return self.programme.counts(letters)
            pieces = [x for x in (before, letters, after) if x]
        elif not low.isascii() and (len(low) != len(word) or unicodedata.normalize("NFC", word) != word) or any(o in word for o in self.openings):
            return None
        else:
            pieces = self.pieces.findall(low)
        out: list[int] = []
        for piece in pieces:
            counts = self.piece_counts.get(piece, 0)
            if counts == 0:
                if len(self.piece_counts) > WORDS_KEPT // 4:
                    self.piece_counts.clear()
                counts = self.piece_counts[piece] = self.programme.counts(piece)
            if counts is None:
                return None
            before_ = out[-1] if out else 0
            out += [before_ + c for c in counts] if before_ else counts
        return out if len(out) == len(word) else None


def gathered(flat: np.ndarray, n: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parts of ``flat``, of the lengths ``n``, in the order of their numbers ``codes``; and where each begins (and at last, ends)."""
    starts, own = np.cumsum(n) - n, n[codes]
    upto = np.concatenate(([0], np.cumsum(own)))
    return flat[np.arange(upto[-1]) + np.repeat(starts[codes] - upto[:-1], own)], upto


_TABLES: dict[str, WordTable] = {}


def table(path: str) -> WordTable:
    """This worker's table for a vocabulary file."""
    if path not in _TABLES:
        _TABLES[path] = WordTable(path)
    return _TABLES[path]


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Parts of a column of texts as bytes, of about ``size`` bytes each, with their first row; a null is an empty text."""
    start, held, total = 0, [], 0
    for i, value in enumerate(batch.column(column)):
        text = value.as_py() or b""
        held.append(text)
        total += len(text)
        if total >= size:
            yield start, held
            start, held, total = i + 1, [], 0
    if held:
        yield start, held


def n_characters(text: bytes) -> int:
    """Code points of UTF-8 bytes."""
    return len(text.decode())


def prefix_steps(texts: list[bytes], known: WordTable) -> list[np.ndarray]:
    """The change of the token count at each character of each text; its running sum is the count at every prefix."""
    codes, ends, words = known.coded(texts)
    known.learn_steps(words)
    own = list(map(known.steps.__getitem__, words))
    # White space adds nothing: one step of 0 after each word, which the last has no use for.
    flat = np.frombuffer(b"".join([w + b"\0\0" for w in own]), "<i2")
    steps, upto = gathered(flat, np.fromiter(map(len, own), np.int64, len(own)) // 2 + 1, codes)
    out = []
    for text, a, b in zip(texts, [0, *ends[:-1].tolist()], ends.tolist()):
        n, found = n_characters(text), steps[upto[a] : max(upto[a], upto[b] - 1)]
        out.append(found if len(found) == n else placed_steps(text, [own[c] for c in codes[a:b].tolist()], n))
    return out


def placed_steps(text: bytes, words: list[bytes], n: int) -> np.ndarray:
    """The same where white space is other than one character between words: each word's steps at its place."""
    out = np.zeros(n, "<i2")
    chars, at, gaps = text.decode(), 0, " \t\n\r\x0b\x0c"
    for steps in words:
        if not steps:
            continue
        while chars[at] in gaps:
            at += 1
        own = np.frombuffer(steps, "<i2")
        out[at : at + len(own)] = own
        at += len(own)
    return out


def count_at(steps: np.ndarray, n_chars: int) -> int:
    """Tokens of the first ``n_chars`` characters."""
    return int(steps[: max(0, n_chars)].sum())


def longest_within(steps: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix that has at most ``budget`` tokens."""
    counts = np.cumsum(steps, dtype=np.int64)
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def prefix_counts(docs: DataFrame, limit: int = 2048, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", store: bool = False) -> DataFrame:
    """Exact token counts of whole texts at every prefix, and what they answer.

    Returns per row ``id_col``, n_bytes (UTF-8), n_tokens (the count at the last
    prefix), over_limit (n_tokens > limit) and chars_within (characters of the
    longest prefix of at most ``limit`` tokens); with ``store``, also
    ``prefix_steps``: 16-bit little-endian steps whose running sum is the count at
    every prefix, for :func:`count_at` and :func:`longest_within`.

    A null or empty text has 0 bytes and 0 tokens.  Rows keep their number:
    repeated rows give repeated results, an empty table gives an empty one.
    Other columns are not read, so their names can't clash.
    """
    path_of = vocabulary_path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table(path_of(vocabulary))
        for batch in batches:
            for start, texts in slices(batch, size=WORD_SLICE_BYTES):
                every = prefix_steps(texts, known)
                n = np.array([int(s.sum(dtype=np.int64)) for s in every], np.int64)
                within = [len(s) if k <= limit else longest_within(s, limit) for s, k in zip(every, n.tolist(), strict=True)]
                cols = [batch.column("id").slice(start, len(texts)), pa.array([len(t) for t in texts], pa.int64()), pa.array(n), pa.array(n > limit), pa.array(within, pa.int64())]
                names = [id_col, "n_bytes", "n_tokens", "over_limit", "chars_within"]
                if store:
                    cols.append(pa.array([s.tobytes() for s in every], pa.binary()))
                    names.append("prefix_steps")
                yield pa.RecordBatch.from_arrays(cols, names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, chars_within bigint" + ", prefix_steps binary" * store
    return rows.mapInArrow(run, schema)
