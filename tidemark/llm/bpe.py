"""Byte-pair encoding and decoding with exact merges.

Pieces of text are encoded by backtracking over the longest vocabulary matches that an Aho-Corasick automaton
finds at every position. A token may follow another only if merging would never have crossed their border; that
is read off the merge tree once for each pair and kept in a pair table. Every position is given up at most once, so the
work is linear in the piece. Decoding slices one buffer of token texts by an offset table.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import documents_of

#: Fixed values of the tokenizer file's kind: how a word's end is marked, and how text is cut into pieces.
WORD_END = "</w>"
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: White space as the tokenizer's patterns see it; str.split() also splits at \x1c-\x1f.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_END = "\ue000"
#: Words whose encoding a worker remembers; past this many it starts anew.
REMEMBERED = 300_000


def byte_alphabet() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves, and the others, in order, as the characters from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Bpe:
    """Encoder and decoder for one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.vocab = {t.replace(WORD_END, _END): i for t, i in vocab.items()}
        size = max([*vocab.values(), *self.special.values()]) + 1
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in merges)]
        self.merged = {(a, b): c for a, b, c in pairs}
        self.parts: list[tuple[int, int] | None] = [None] * size
        self.rank = [-1] * size
        for r, (a, b, c) in enumerate(pairs):
            self.parts[c], self.rank[c] = (a, b), r
        self.length, self.shorter = [0] * size, [-1] * size
        self.automaton = ahocorasick.Automaton()
        for text, i in self.vocab.items():
            self.length[i] = len(text)
            self.automaton.add_word(text, (len(text) - 1, i))
            self.shorter[i] = next((self.vocab[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.vocab), -1)
        self.automaton.make_automaton()
        self.table = {b: c for b, c in byte_alphabet().items() if chr(b) != c}
        self.compatible: dict[int, bool] = {}  # the pair table, by first << 32 | second
        self._pieces = regex.compile(PIECES)
        self._special = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self._odd_space = re.compile("[\x1c-\x1f]")
        self._space = re.compile(f"[{SPACE}]+")
        names = dict.fromkeys(range(size), "") | {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        encoded = [names[i].encode() for i in range(size)]
        buffer, offsets = b"".join(encoded), np.cumsum([0, *map(len, encoded)]).tolist()
        self.texts = [buffer[a:b] for a, b in zip(offsets, offsets[1:])]
        self.id_bytes = [i.to_bytes(4, "little") for i in range(size)]
        self.words = Words(self.word)
        self.pieces: dict[str, bytes] = {}

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging the text of both, side by side, leaves exactly these two tokens.

        Both tokens are taken apart from the border, latest merge first; at no time may a merge across the border
        have come before the merge that is being undone.
        """
        rank, parts, merged = self.rank, self.parts, self.merged
        undone = len(rank)  # rank of the merge undone last
        from_left = False
        while True:
            over = merged.get((left, right))
            if over is not None and (rank[over] < undone or rank[over] == undone and not from_left):
                return False
            if rank[left] < 0 and rank[right] < 0:
                return True
            if rank[left] > rank[right]:
                undone, left, from_left = rank[left], parts[left][1], True
            else:
                undone, right, from_left = rank[right], parts[right][0], False

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """Token ids of one piece, given in the byte alphabet with its end marked."""
        whole = self.vocab.get(piece)
        if whole is not None:
            return (whole,)
        n, length, shorter, compatible = len(piece), self.length, self.shorter, self.compatible
        longest = [-1] * n
        for end, (back, token) in self.automaton.iter(piece):  # of the matches from one start, the longest comes last
            longest[end - back] = token
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token, last = 0, longest[0], -1
        while at < n:
            while token >= 0:
                if not dead[at + length[token]]:
                    if last < 0:
                        break
                    ok = compatible.get(last << 32 | token)
                    if ok is None:
                        ok = compatible[last << 32 | token] = self.may_follow(last, token)
                    if ok:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                last = token
                token = longest[at] if at < n else -1
            else:
                dead[at] = 1
                token = out.pop()
                at -= length[token]
                last = out[-1] if out else -1
        return tuple(out)

    def _piece(self, piece: str) -> bytes:
        if len(self.pieces) >= REMEMBERED:
            self.pieces.clear()
        if len(self.compatible) >= REMEMBERED:
            self.compatible.clear()
        ids = self.encode_piece(piece.encode("utf-8", "replace").decode("latin-1").translate(self.table) + _END)
        got = self.pieces[piece] = b"".join([self.id_bytes[i] for i in ids])
        return got

    def word(self, word: str) -> bytes:
        """Ids (little-endian, 4 bytes each) of a word that holds no white space."""
        text = word.lower() if word.isascii() else unicodedata.normalize("NFC", word).replace("Σ", "σ").lower()
        if text.isalpha() and text.isascii():
            return self.pieces.get(text) or self._piece(text)
        return b"".join([self.pieces.get(piece) or self._piece(piece) for piece in self._pieces.findall(text)])

    def _plain(self, text: str) -> list[bytes]:
        return list(map(self.words.__getitem__, text.split() if not self._odd_space.search(text) else filter(None, self._space.split(text))))

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if "<|" not in text or not self._special:
            return b"".join(self._plain(text))
        out, at = [], 0
        for hit in self._special.finditer(text):
            out += self._plain(text[at : hit.start()])
            out.append(self.id_bytes[self.special[hit[0]]])
            at = hit.end()
        return b"".join(out + self._plain(text[at:]))

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 text of ids: slices of the token buffer by the offset table, which this kind of tokenizer joins by spaces."""
        return b" ".join(map(self.texts.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Words(dict):
    """Ids of the words met so far, worked out on first sight."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, word: str) -> bytes:
        if len(self) >= 3 * REMEMBERED:
            self.clear()
        got = self.of(word)
        if len(word) < 200:
            self[word] = got
        return got


@functools.lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """The tables of a tokenizer file, built once for each Python worker."""
    return Bpe(path)


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), n_tokens and decoded text of every document.

    Null text is empty text: no ids, empty decoded text. Repeated rows give repeated results; a null doc_id stays null.
    Whole texts are encoded. The tokenizer file must be at the same path on every machine.
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for batch in batches:
            ids = [bpe.encode(t) for t in batch.column("text").to_pylist()]
            columns = [batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([bpe.decode(x).decode() for x in ids], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "n_tokens", "decoded"])

    return documents_of(docs).mapInArrow(encode, "doc_id long, ids binary, n_tokens long, decoded string")


def encoded_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """As encode_documents, with SHA-256 digests in place of ids and text, made where the text is so that neither leaves the task."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for batch in batches:
            n, a, b = [], [], []
            for text in batch.column("text"):
                ids = bpe.encode(text.as_py())
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents_of(docs).mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
