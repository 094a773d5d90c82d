"""Byte-level BPE by dynamic programming over prefixes, and decoding.

For each prefix of a pre-token the encoding ends in one token only. That token is found
among the vocabulary entries which are suffixes of the prefix (an automaton over the
vocabulary reports them): the one that can follow the stored last token of the
remaining shorter prefix, that is, for which encoding the two tokens' bytes gives the
two tokens again. Following the stored tokens back from the end gives the exact ids, in
time linear in the text, where applying merges one by one is not.

Texts are cut at spaces and line ends that follow a character other than white space,
where a pre-token always begins; the ids of such a piece do not depend on its
surroundings, and each worker process keeps those of the pieces it has seen, up to a
fixed number.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pieces, pre-tokens and pairs of tokens that a worker process keeps, and the longest that it keeps.
CACHE_PIECES, CACHE_WORDS, CACHE_PAIRS, CACHE_LENGTH = 700_000, 300_000, 1_000_000, 64
#: Characters of text that are turned into ids before a batch of rows is handed on.
BATCH_CHARS = 4_000_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class Pieces(dict):
    """Ids, as the bytes of unsigned 32-bit numbers, of the pieces seen so far; before is what stands before each."""

    def __init__(self, encoder: Encoder, before: str) -> None:
        super().__init__()
        self.encoder, self.before = encoder, before

    def __missing__(self, piece: str) -> bytes:
        text = piece if piece[:1] == "\n" else self.before + piece
        ids = self.encoder.ids_of_segment(text)
        if len(piece) <= CACHE_LENGTH:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Exact ids of a byte-level BPE vocabulary (a tokenizers JSON file)."""

    def __init__(self, path: str) -> None:
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        alphabet = byte_alphabet()
        byte_of = {c: b for b, c in enumerate(alphabet)}
        self.vocab, self.to_alphabet = vocab, dict(enumerate(alphabet))
        size = max([*vocab.values(), *(t["id"] for t in spec.get("added_tokens", []))]) + 1
        self.length = [0] * size
        self.bytes: list[bytes] = [b""] * size
        for s, i in vocab.items():
            self.length[i], self.bytes[i] = len(s), bytes(byte_of[c] for c in s)
        #: By token: the merge that makes it (-1: none) and that merge's halves; by pair of tokens: its merge.
        self.made_by, self.left, self.right = [-1] * size, [0] * size, [0] * size
        self.merge: dict[tuple[int, int], int] = {}
        for n, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merge[vocab[a], vocab[b]] = n
            if self.made_by[made := vocab[a + b]] < 0:
                self.made_by[made], self.left[made], self.right[made] = n, vocab[a], vocab[b]
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        for s, i in self.specials.items():
            self.bytes[i] = s.encode()
        longest_first = sorted(self.specials, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if longest_first else None
        self.pretokens = regex.compile(PATTERN).findall
        #: White space in a row, or at the end: what a piece gives then depends on its neighbours.
        self.irregular = [re.compile(x).search for x in (r" \s", r"\n\s", r"\n(?<=\s\n)")]
        self.suffixes = ahocorasick.Automaton()
        for s, i in vocab.items():
            self.suffixes.add_word(s, i)
        self.suffixes.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, bytes] = {}
        self.first, self.later = Pieces(self, ""), Pieces(self, " ")

    def compatible(self, a: int, b: int) -> bool:
        """Whether the bytes of tokens a and b encode as a, b.

        The two tokens' own merges are undone, the latest first. A merge across their
        border that would have come before the one undone last would have been made
        instead; of equal merges the left one comes first.
        """
        key = (a, b)
        limit = len(self.merge)
        while True:
            across = self.merge.get((a, b))
            if across is not None and across < limit:
                good = False
                break
            of_a, of_b = self.made_by[a], self.made_by[b]
            if of_a > of_b:
                limit, a = of_a, self.right[a]
            elif of_b >= 0:
                limit, b = of_b + 1, self.left[b]
            else:
                good = True
                break
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        self.pairs[key] = good
        return good

    def ids_of_word(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        s = word.encode().decode("latin-1").translate(self.to_alphabet)
        if (whole := self.vocab.get(s)) is not None:
            return [whole]
        last = [-1] * (len(s) + 1)
        length, known, compatible = self.length, self.pairs.get, self.compatible
        for end, token in self.suffixes.iter(s):
            end += 1
            if last[end] < 0:
                if start := end - length[token]:
                    if (good := known((last[start], token))) is None:
                        good = compatible(last[start], token)
                    if good:
                        last[end] = token
                else:
                    last[end] = token
        ids, at = [], len(s)
        while at:
            ids.append(last[at])
            at -= length[last[at]]
        ids.reverse()
        return ids

    def ids_of_segment(self, text: str) -> bytes:
        """Ids of a text without special tokens, pre-token by pre-token."""
        out, words = [], self.words
        for word in self.pretokens(text):
            if (ids := words.get(word)) is None:
                ids = array("I", self.ids_of_word(word)).tobytes()
                if len(word) <= CACHE_LENGTH:
                    if len(words) >= CACHE_WORDS:
                        words.clear()
                    words[word] = ids
            out.append(ids)
        return b"".join(out)

    def ids_of_text(self, text: str) -> bytes:
        """Ids of a text, as the bytes of unsigned 32-bit numbers."""
        if any(s in text for s in self.specials):
            parts = self.cut.split(text)
            return b"".join(array("I", [self.specials[p]]).tobytes() if n % 2 else self.ids_of_text(p) for n, p in enumerate(parts))
        if not text:
            return b""
        if text[-1] in " \n" or any(found(text) for found in self.irregular):
            return self.ids_of_segment(text)
        head, *rest = text.replace("\n", " \n").split(" ")
        later = self.later
        return self.first[head] + b"".join([later[p] for p in rest]) if head else b"".join([later[p] for p in rest])

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.ids_of_text(text or ""), np.uint32)

    def decode(self, ids: Iterable[int]) -> str:
        """The bytes of all tokens, special ones included, read as UTF-8 (other bytes: U+FFFD)."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for the vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def text_slices(batch: pa.RecordBatch, text_at: int = 1, chars: int = BATCH_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """A batch in slices of about chars characters at most (one row at least), with their texts; null: empty."""
    sizes = np.diff(np.asarray(pc.fill_null(pc.binary_length(batch.column(text_at)), 0).cast(pa.int64())).cumsum(), prepend=0)
    start, held = 0, 0
    for n, size in enumerate(sizes):
        if held and held + size > chars:
            part = batch.slice(start, n - start)
            yield part, [t or "" for t in part.column(text_at).to_pylist()]
            start, held = n, 0
        held += int(size)
    if batch.num_rows > start:
        part = batch.slice(start)
        yield part, [t or "" for t in part.column(text_at).to_pylist()]


def list_array(parts: list[bytes]) -> pa.ListArray:
    """Lists of 32-bit ids."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def bpe_encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """One row for each row of docs: id, ids array<int> and, with decode, the text decoded from them.

    Whole texts are encoded, as without truncation, padding or added special tokens; the
    string of a special token in a text gives that token. A null text counts as empty and
    has no ids. Rows, and repeated rows, stay as they are; other columns are not read.
    vocabulary: a path that every executor can read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(vocabulary)
        for batch in batches:
            for part, texts in text_slices(batch):
                ids = [known.ids_of_text(t) for t in texts]
                columns = [part.column(0), list_array(ids)]
                if decode:
                    columns.append(pa.array([known.decode(np.frombuffer(x, np.uint32).tolist()) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = [id_col, "ids", *["decoded"] * decode]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, ids array<int>" + ", decoded string" * decode
    return docs.select(F.col(id_col), F.col(text_col).alias("_text")).mapInArrow(run, schema)


def bpe_decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row for each row of encoded: id and text, the tokens' bytes read as UTF-8; null ids: null.

    A null or an id that the vocabulary does not have adds nothing, as in the tokenizers
    library; bytes that are not UTF-8 become U+FFFD.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(vocabulary)
        for batch in batches:
            size = len(known.bytes)
            texts = [None if x is None else known.decode([n for n in x if n is not None and 0 <= n < size]) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, f"`{id_col}` {kind}, text string")
