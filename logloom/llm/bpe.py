"""Byte-level BPE by backtracking over longest matches.

A sequence of tokens is the one that merging by rank yields exactly when every pair of neighbours in it is: so it is
enough to walk from left to right with the longest vocabulary entry at each place, to test the pair with the token
before (an answer worth remembering, as pairs recur), and to take the next shorter entry, or a step back, when the pair
fails. Each place is left for good once all entries from it failed, which bounds the work by the length of the text.
The places' longest entries come from an Aho-Corasick automaton over Latin-1 images of the entries' bytes.

Nulls: a null text is encoded as the empty one, which has no ids. A null doc_id is kept. Repeated rows stay repeated.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import cached_property
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .shared import rows, texts

#: Pieces and pairs that a worker remembers at most, and characters of the longest piece among them.
REMEMBERED, LONGEST = 300_000, 64
#: Finds a character besides ASCII (without separators that matchers treat differently) and Latin letters.
UNUSUAL = re.compile("[^\t\n\r\x20-\x7e\u00c0-\u024f]").search
#: Characters of text that are handled at a time.
AT_A_TIME = 1 << 20


class _Remembered(dict):
    """A mapping that computes what it lacks; when it is full it keeps its older half, where the frequent keys are. Long texts among
    the keys (runs of letters or signs without a break) are computed each time, so that memory has a bound in bytes."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, key):
        if isinstance(key, str) and len(key) > LONGEST:
            return self.compute(key)
        if len(self) >= REMEMBERED:
            kept = dict(islice(self.items(), REMEMBERED // 2))
            self.clear()
            self.update(kept)
        self[key] = value = self.compute(key)
        return value


class Codec:
    """Encoder and decoder for a rank file (lines of base64 entry and rank) and a splitting pattern.

    Ranks must be 0, 1, 2, ... in the order of the merges, all 256 single bytes among them, as in public rank files.
    """

    def __init__(self, rank_file: bytes, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        self.entry = sorted(ranks, key=ranks.get)
        if [ranks[x] for x in self.entry] != list(range(len(ranks))) or any(bytes([i]) not in ranks for i in range(256)):
            raise ValueError("ranks must be dense and hold all single bytes")
        self.rank, self._full, self._plain = ranks, regex.compile(pattern).findall, None
        # among usual characters, letters are the word characters besides digits and "_", and numbers are the digits
        plain = pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)")
        if not re.search(r"\[[^]]*\\p", plain):
            plain = plain.replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
            self._plain = None if r"\p" in plain else re.compile(plain).findall
        self.size = list(map(len, self.entry))
        self.piece = _Remembered(lambda piece: np.array(self.encode_piece(piece.encode()), "<u4").tobytes())
        self.fits = _Remembered(self._fits)

    @cached_property
    def automaton(self):
        found = ahocorasick.Automaton()
        for i, x in enumerate(self.entry):
            found.add_word(x.decode("latin-1"), i)
        found.make_automaton()
        return found

    @cached_property
    def shorter(self) -> list[int]:
        """For each entry the longest other entry that it starts with, or -1."""
        return [next((self.rank[x[:k]] for k in range(len(x) - 1, 0, -1) if x[:k] in self.rank), -1) for x in self.entry]

    @cached_property
    def merges(self) -> tuple[list[tuple[int, int]], dict[tuple[int, int], int]]:
        """The two parts that merge into each entry (itself twice for a single byte), and the reverse of that."""
        parts, whole = [], {}
        for i, x in enumerate(self.entry):
            pair = (i, i)
            for k in range(1, len(x)):
                a, b = self.rank.get(x[:k], i), self.rank.get(x[k:], i)
                if a < i and b < i and self._stays_apart(a, b, parts, whole):
                    pair = (a, b)
                    whole[pair] = i
                    break
            parts.append(pair)
        return parts, whole

    @staticmethod
    def _stays_apart(a: int, b: int, parts, whole) -> bool:
        """Whether merging the bytes of a and b by rank ends with a, b: no merge across their border comes early enough.

        Undoes merges from the latest on, at whichever side of the border has the later one, and looks for a merge
        of the two pieces at the border that would have come before the one just undone.
        """
        bound = len(parts) + 1 << 32
        while True:
            if whole.get((a, b), bound) < bound:
                return False
            if a > b:
                bound, right = a, parts[a][1]
                if right != a:
                    a = right
                    continue
                bound, left = b + 1, parts[b][0]
                if left == b:
                    return True
                b = left
            else:
                bound, left = b + 1, parts[b][0]
                if left != b:
                    b = left
                    continue
                bound, right = a, parts[a][1]
                if right == a:
                    return True
                a = right

    def _fits(self, pair: tuple[int, int]) -> bool:
        return self._stays_apart(*pair, *self.merges)

    def split(self, text: str) -> list[str]:
        """The matches of the pattern. The standard library's matcher is the faster one where it knows all characters."""
        return self._full(text) if self._plain is None or UNUSUAL(text) else self._plain(text)

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        if piece in self.rank:
            return [self.rank[piece]]
        n, size, fits, shorter = len(piece), self.size, self.fits, self.shorter
        longest = [0] * n
        for last, token in self.automaton.iter(piece.decode("latin-1")):  # by growing ends: the longest from a place comes last
            longest[last + 1 - size[token]] = token
        out, at, before, open_ = [], 0, -1, bytearray(b"\1" * (n + 1))
        token = longest[0] if n else -1
        while token >= 0:
            end = at + size[token]
            if open_[end] and (before < 0 or fits[before, token]):
                out.append(token)
                if end == n:
                    break
                at, before, token = end, token, longest[end]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:  # nothing from here on goes with what stands before: this place is closed
                open_[at] = 0
                token = out.pop()
                at -= size[token]
                before = out[-1] if out else -1
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.piece.__getitem__, self.split(text)))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.entry.__getitem__, ids))


_CODECS: dict[tuple[bytes, str], Codec] = {}


def codec(rank_file: bytes, pattern: str) -> Codec:
    """The codec of this worker for these ranks."""
    key = hashlib.sha256(rank_file).digest(), pattern
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(rank_file, pattern)
    return _CODECS[key]


def _ranks(df: DataFrame, rank_path: str):
    with open(rank_path, "rb") as f:  # a vocabulary file: below a few MB whatever the corpus
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) of each row's whole text."""
    ranks = _ranks(df, rank_path)

    def run(batches):
        c = codec(ranks.value, pattern)
        for doc_id, text in rows(batches, "doc_id", "text"):
            ids = np.frombuffer(c.encode(text or ""), "<i4")
            yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids))], ["doc_id", "ids"])

    return texts(df).mapInArrow(run, "doc_id long, ids array<int>")


def decode(df: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """(doc_id, data binary) of each row's ids; null ids give the empty data, an unknown id fails the job."""
    ranks = _ranks(df, rank_path)

    def run(batches):
        c = codec(ranks.value, pattern)
        for doc_id, ids in rows(batches, "doc_id", "ids"):
            yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([c.decode(ids or ())], pa.binary())], ["doc_id", "data"])

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip(df: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """Encodes each whole text, decodes its ids again, and returns the digests of both.

    (doc_id, n_tokens, ids_sha256, decoded_sha256): lower-case hex; ids as little-endian unsigned 32-bit integers.
    """
    ranks = _ranks(df, rank_path)

    def run(batches):
        c = codec(ranks.value, pattern)
        for batch in batches:
            found = [[], [], [], []]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = c.encode(text.as_py() or "")
                numbers = np.frombuffer(ids, "<u4")
                back = hashlib.sha256()
                for k in range(0, len(numbers), AT_A_TIME):
                    back.update(c.decode(numbers[k : k + AT_A_TIME].tolist()))
                for column, x in zip(found, (doc_id, len(numbers), hashlib.sha256(ids).hexdigest(), back.hexdigest()), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(df).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
