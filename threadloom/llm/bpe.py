"""Exact byte-pair encoding by dynamic programming over prefixes, and its decoding.

For every prefix of a piece exactly one token can come last in the piece's byte-pair
encoding. A suffix automaton of the vocabulary finds, at each position, the tokens that
end there; the first whose pair with the last token of the remaining prefix survives all
merges is that unique token. Following these back-pointers emits the exact ids. The
vocabulary is that of a public tokenizer file whose path is a parameter.

Defined results: a null or empty text has no ids and decodes to ''; white-space-only texts
too; texts of any length are encoded whole; repeated rows get equal rows; other columns
are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import string
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.normalizers import NFC

from threadloom.llm.common import sliced

# Unicode's White_Space, and the contractions that the pre-tokenizer cuts off.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
#: What the pre-tokenizer takes as pieces.
PIECES = regex.compile(rf"{_SHORT}|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
#: str.split() also splits at these, which are no white space.
_NOT_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")
_MARKS = string.punctuation
_END = 256  # added to the last byte of a piece: symbols are 0 to 511


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Specials:
    """Strings that are one token wherever they stand in a raw text."""

    def __init__(self, added: list[dict]):
        self.ids = {t["content"]: t["id"] for t in added}
        self.firsts = {t[0] for t in self.ids if t}
        self._find = regex.compile("|".join(map(regex.escape, self.ids)))

    def possible(self, text: str) -> bool:
        """Whether the text holds the first character of any special string."""
        return any(c in text for c in self.firsts)

    def split(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Stretches of ordinary text, each with the id of the special string after it."""
        at = 0
        for m in self._find.finditer(text) if self.ids else ():
            yield text[at : m.start()], self.ids[m[0]]
            at = m.end()
        yield text[at:], None


class Vocabulary:
    """Tokens, merges and the suffix automaton of a byte-level vocabulary with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        suffix = spec["model"]["end_of_word_suffix"]
        ids = spec["model"]["vocab"]
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        self.special = Specials(spec["added_tokens"])
        names = {i: t for t, i in [*ids.items(), *self.special.ids.items()]}
        self.name = [names.get(i, "") for i in range(max(names, default=-1) + 1)]
        symbols: dict[int, tuple[int, ...]] = {}
        for t, i in ids.items():
            ended = t.endswith(suffix)
            s = [byte_of[c] for c in t.removesuffix(suffix)]
            if ended:
                s[-1] += _END
            symbols[i] = tuple(s)
        #: Two tokens that merge, and each token's two parts and the rank of its merge.
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank = dict.fromkeys(ids.values(), -1)
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            whole = ids[a + b]
            self.merged[ids[a], ids[b]] = whole
            if whole not in self.parts:
                self.parts[whole], self.rank[whole] = (ids[a], ids[b]), rank
        self._fits: dict[tuple[int, int], bool] = {}
        self._alone: dict[int, bool] = {}
        self._automaton(symbols)

    def _automaton(self, symbols: dict[int, tuple[int, ...]]) -> None:
        """The automaton of all substrings of tokens, grown over the trie of tokens by breadth."""
        trie: list[dict[int, int]] = [{}]
        token_at: list[int] = [-1]
        for i, s in symbols.items():
            at = 0
            for c in s:
                nxt = trie[at].get(c)
                if nxt is None:
                    trie[at][c] = nxt = len(trie)
                    trie.append({})
                    token_at.append(-1)
                at = nxt
            token_at[at] = i
        step: list[dict[int, int]] = [{}]
        link, length, token = [-1], [0], [-1]

        def grow(last: int, c: int) -> int:
            new = len(step)
            step.append({})
            length.append(length[last] + 1)
            link.append(0)
            token.append(-1)
            p = last
            while p >= 0 and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p >= 0:
                q = step[p][c]
                if length[q] != length[p] + 1:
                    copy = len(step)
                    step.append(dict(step[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    token.append(-1)
                    link[q] = copy
                    while p >= 0 and step[p].get(c) == q:
                        step[p][c] = copy
                        p = link[p]
                    q = copy
                link[new] = q
            return new

        level = [(0, 0)]
        while level:
            below = []
            for node, state in level:
                for c, child in trie[node].items():
                    own = step[state].get(c)
                    if own is None or length[own] != length[state] + 1:
                        own = grow(state, c) if own is None else self._split(step, link, length, token, state, c, own)
                    token[own] = token_at[child] if token_at[child] >= 0 else token[own]
                    below.append((child, own))
            level = below
        for v, t in enumerate(token):
            if t >= 0 and not self.alone(t):
                token[v] = -1  # never emitted
        #: The nearest shorter suffix that is a token.
        up = [-1] * len(step)
        for v in sorted(range(1, len(step)), key=length.__getitem__):
            up[v] = link[v] if token[link[v]] >= 0 else up[link[v]]
        self.step, self.link, self.length, self.token, self.up = step, link, length, token, up

    @staticmethod
    def _split(step, link, length, token, state: int, c: int, old: int) -> int:
        """A state of its own for the string of ``state`` and ``c``, which so far shares one with longer strings."""
        new = len(step)
        step.append(dict(step[old]))
        length.append(length[state] + 1)
        link.append(link[old])
        token.append(-1)
        link[old] = new
        p = state
        while p >= 0 and step[p].get(c) == old:
            step[p][c] = new
            p = link[p]
        return new

    def fits(self, a: int, b: int) -> bool:
        """Whether the encoding of the two tokens' joined symbols is just these two.

        It is not if a merge across their border comes before the merges that make the
        tokens at that border: these are undone from the last, and each pair that then
        touches the border is looked up.
        """
        known = self._fits.get((a, b))
        if known is None:
            if len(self._fits) > 500_000:
                self._fits.clear()
            known = self._fits[a, b] = self._survives(a, b)
        return known

    def _survives(self, a: int, b: int, but: int | None = None) -> bool:
        """``but``: the token that a and b are expected to merge to in the end."""
        rank, merged, parts = self.rank, self.merged, self.parts
        until = float("inf")  # merges across the border count below this rank
        while True:
            whole = merged.get((a, b))
            if whole is not None and whole != but and rank[whole] < until:
                return False
            but = None
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                until, a = ra, parts[a][1]
            else:  # of merges of one rank the left one comes first: b's is the last, and after one across the border
                until, b = rb + 0.5, parts[b][0]

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one piece of the pre-tokenizer."""
        raw = [*piece.encode("utf-8")]
        raw[-1] += _END
        step, link, length, token, up, known = self.step, self.link, self.length, self.token, self.up, self._fits
        last: list[int] = [-1]  # the unique last token of each prefix
        start: list[int] = [0]
        state = matched = 0
        for end, c in enumerate(raw, 1):
            to = step[state].get(c)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = step[state].get(c)
            if to is None:
                raise ValueError(f"no token has the byte at {end - 1} of {piece!r}")
            state = to
            matched += 1
            v = state if token[state] >= 0 and length[state] <= matched else up[state]
            while v > 0:
                t, at = token[v], end - length[v]
                if not at:
                    break
                fit = known.get((last[at], t))
                if fit or fit is None and self.fits(last[at], t):
                    break
                v = up[v]
            else:
                raise ValueError(f"no token ends at {end - 1} of {piece!r}")
            last.append(t)
            start.append(at)
        ids, at = [], len(raw)
        while at:
            ids.append(last[at])
            at = start[at]
        return ids[::-1]

    def alone(self, t: int) -> bool:
        """Whether merges make this token from its own symbols; no other token is ever emitted."""
        known = self._alone.get(t)
        if known is None:
            a, b = self.parts.get(t, (-1, -1))
            known = self._alone[t] = a < 0 or self.alone(a) and self.alone(b) and self._survives(a, b, but=t)
        return known

    def decode(self, ids: list[int]) -> str:
        """The tokens' names, joined by blanks: this vocabulary's file names no decoder."""
        return " ".join(map(self.name.__getitem__, ids))


def pieces_of(chunk: str) -> list[str]:
    """What the pre-tokenizer makes of a chunk without white space."""
    word = chunk.rstrip(_MARKS)
    if word.isalpha():  # most chunks are a word and perhaps marks
        return [word, chunk[len(word) :]] if len(word) < len(chunk) else [word]
    return PIECES.findall(chunk)


class Chunks(dict):
    """Ids, as 32-bit unsigned integers in bytes, of chunks without white space and of their pieces.

    Short ones already seen are kept in two generations of at most ``most`` each: a full
    one becomes the old one, and what is used again moves to the new one. So common chunks
    stay and memory is bounded.
    """

    def __init__(self, encode_piece: Callable[[str], list[int]], most: int = 600_000):
        super().__init__()
        self.encode_piece, self.most, self.old = encode_piece, most, {}

    def __missing__(self, chunk: str | int) -> bytes:
        """A chunk that isn't kept, or the id of a special string."""
        if isinstance(chunk, int):
            return array("I", [chunk]).tobytes()
        return b"".join(self.encoded(pieces_of(chunk)))

    def encoded(self, pieces: list[str]) -> Iterable[bytes]:
        """Ids of each of the pieces."""
        return (array("I", self.encode_piece(p)).tobytes() for p in pieces)

    def learn(self, chunks: Iterable[str | int]) -> None:
        """Keeps the short ones of the distinct chunks, and encodes those that are new together."""
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        old, new, split = self.old, {}, []
        for c in chunks:
            if c in old:
                self[c] = old[c]
            elif isinstance(c, str) and len(c) <= 64:
                pieces = pieces_of(c)
                if len(pieces) > 1:
                    split.append((c, pieces))
                for p in pieces:
                    if p not in self:
                        new[p] = None
        for p in [p for p in new if p in old]:
            self[p] = old[p]
            del new[p]
        self.update(zip(new, self.encoded([*new]), strict=True))
        look = self.__getitem__
        self.update((c, b"".join(map(look, pieces))) for c, pieces in split)

    def of_texts(self, texts: list[list[str | int]]) -> list[bytes]:
        """Ids of whole texts that are given as their parts."""
        known = [[*map(self.get, parts)] for parts in texts]
        self.learn({c for parts, own in zip(texts, known, strict=True) if None in own for c, ids in zip(parts, own, strict=True) if ids is None})
        return [b"".join([self[c] if ids is None else ids for c, ids in zip(parts, own, strict=True)] if None in own else own) for parts, own in zip(texts, known, strict=True)]


_NFC = NFC()


def _plain(text: str) -> str:
    """Composed normal form in lower case, letter by letter (no final sigma)."""
    if not unicodedata.is_normalized("NFC", text):
        text = _NFC.normalize_str(text)  # the library's, whose Unicode version knows fewer marks than Python's
    return text.replace("Σ", "σ").lower()


_spaces = regex.compile(f"[{_SPACE}]+")


def chunks_of(text: str) -> list[str]:
    text = _plain(text)
    return [c for c in _spaces.split(text) if c] if any(c in text for c in _NOT_SPACE) else text.split()


def parts_of(text: str | None, special: Specials) -> list[str | int]:
    """Chunks of a whole text, and ids of the special strings among them."""
    text = text or ""
    if not special.possible(text):
        return chunks_of(text)
    out: list[str | int] = []
    for ordinary, then in special.split(text):
        out += chunks_of(ordinary)
        if then is not None:
            out.append(then)
    return out


@cache
def vocabulary_at(path: str) -> Vocabulary:
    """Read and built once in each Python worker."""
    return Vocabulary(path)


@cache
def chunks_at(path: str) -> Chunks:
    return Chunks(vocabulary_at(path).encode_piece)


def encode_decode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array of ints) and the text that the ids decode to, for every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, seen = vocabulary_at(vocabulary_path), chunks_at(vocabulary_path)
        for b in sliced(batches, 1500):
            ids = [np.frombuffer(raw, np.uint32).astype(np.int32) for raw in seen.of_texts([parts_of(t, v.special) for t in b.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([v.decode(x.tolist()) for x in ids], pa.string())], names=["id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def round_trip_digests(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian 32-bit integers) and decoded_sha256 of every whole text.

    The digests are taken where the ids are made, so that only they leave the workers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, seen = vocabulary_at(vocabulary_path), chunks_at(vocabulary_path)
        for b in sliced(batches, 1500):
            n, of_ids, of_text = [], [], []
            for raw in seen.of_texts([parts_of(t, v.special) for t in b.column(1).to_pylist()]):
                ids = np.frombuffer(raw, "<u4")
                n.append(len(ids))
                of_ids.append(hashlib.sha256(raw).hexdigest())
                of_text.append(hashlib.sha256(v.decode(ids.tolist()).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
