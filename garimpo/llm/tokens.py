"""Encoding a corpus with a public byte-level BPE vocabulary.

Method: per-prefix dynamic programming. For every prefix of a piece of text there is one token that ends its
encoding. It is found among the vocabulary's matches that end there, which a suffix automaton (Aho-Corasick) lists, as
the one that is compatible with the last token of the prefix before it; back-pointers then give the ids. Two tokens are
compatible if no merge would have joined across their border first. The result is exactly that of merging by rank.

The piece is what lies between safe borders of the pretokenizer; each worker remembers pieces it has met, so most of a
corpus is joined from ready ids by C code.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pretokenizer's pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The characters that ``\s`` of the pattern means.
WHITE = frozenset("\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
#: Pieces remembered by a worker; beyond it, what was remembered is dropped.
CACHE = 400_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The file of a public vocabulary: in ``GARIMPO_TOKENIZERS``, the installed package or /opt/tokenizers."""
    if folder := os.environ.get("GARIMPO_TOKENIZERS"):
        return str(Path(folder, name))
    try:
        import public_tokenizers

        return str(public_tokenizers.path(name))
    except ImportError:
        return str(Path("/opt/tokenizers", name))


class Vocabulary:
    """Tokens by rank, the merge each one came from, and the automaton over all of them."""

    def __init__(self, raw: bytes, births: np.ndarray | None = None) -> None:
        """``births``: left and right part of every rank, as another instance found them."""
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in raw.splitlines() if x.strip())}
        size = max(self.ranks.values()) + 1
        self.length = [0] * size
        for t, r in self.ranks.items():
            self.length[r] = len(t)
        self.joined: dict[tuple[int, int], int] = {}
        if births is None:
            self.left, self.right = list(range(size)), list(range(size))
            for t, r in sorted(self.ranks.items(), key=lambda x: x[1]):
                if len(t) > 1:
                    self.left[r], self.right[r] = pair = self._born(t, r)
                    self.joined[pair] = r
        else:
            self.left, self.right = births.tolist()
            self.joined = {(a, b): r for r, (a, b) in enumerate(zip(self.left, self.right)) if self.length[r] > 1}
        self.known: dict[tuple[int, int], bool] = {}
        self.automaton = self._automaton()

    @property
    def births(self) -> np.ndarray:
        return np.array([self.left, self.right], dtype=np.int32)

    def _born(self, t: bytes, rank: int) -> tuple[int, int]:
        """The two tokens whose merge made ``t``: merge its bytes by rank until two parts are left."""
        if len(t) == 2:
            return self.ranks[t[:1]], self.ranks[t[1:]]
        parts = [self.ranks[t[i : i + 1]] for i in range(len(t))]
        while len(parts) > 2:
            best = min(((self.joined.get((a, b), rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
            if best[0] >= rank:
                raise ValueError(f"token {rank} cannot be reached by merges")
            parts[best[1] : best[1] + 2] = [best[0]]
        return parts[0], parts[1]

    def _automaton(self):  # noqa: ANN202
        import ahocorasick

        a = ahocorasick.Automaton()
        for t, r in self.ranks.items():
            a.add_word(t.decode("latin-1"), r)
        a.make_automaton()
        return a

    def compatible(self, a: int, b: int) -> bool:
        """Whether ``a`` followed by ``b`` is how their text is encoded.

        The border is seen at falling ranks: of the two tokens beside it, the one merged later is taken apart, down to
        the part that touches the border. If at any time the parts could merge earlier than what they were merged into,
        that merge would have come first.
        """
        first = (a, b)
        if (got := self.known.get(first)) is not None:
            return got
        before = len(self.left) + 1  # ranks from here on have been taken apart
        ok = True
        while True:
            m = self.joined.get((a, b))
            if m is not None and m < before:
                ok = False
                break
            split_a, split_b = self.right[a] != a, self.left[b] != b
            if not split_a and not split_b:
                break
            if split_a and (a > b or not split_b):
                before, a = a, self.right[a]
            else:
                # of equal ranks the left one was merged first, so a merge of the same rank still counts
                before, b = b + 1, self.left[b]
        if len(self.known) > 2_000_000:
            self.known.clear()
        self.known[first] = ok
        return ok

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pretoken."""
        if (r := self.ranks.get(piece)) is not None:
            return [r]
        n = len(piece)
        last = [-1] * (n + 1)
        length, compatible = self.length, self.compatible
        for end, r in self.automaton.iter(piece.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            before = end - length[r]
            if before == 0 or (last[before] >= 0 and compatible(last[before], r)):
                last[end] = r
        out = []
        while n:
            out.append(last[n])
            n -= length[last[n]]
        return out[::-1]


class _Pretokens(dict):
    """Pretokens to their ids as bytes of int32."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> bytes:
        b = array("i", self.vocabulary.encode_piece(piece.encode("utf-8", "surrogatepass"))).tobytes()
        if len(piece) < 64:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = b
        return b


class Encoder(dict):
    """Parts of a text between safe borders to their ids as bytes of int32."""

    def __init__(self, vocabulary: Vocabulary, pattern: str = PATTERN) -> None:
        super().__init__()
        self.find = regex.compile(pattern).findall
        self.pretokens = _Pretokens(vocabulary)

    def __missing__(self, text: str) -> bytes:
        b = b"".join(map(self.pretokens.__getitem__, self.find(text)))
        if len(text) < 256:
            if len(self) >= CACHE:
                self.clear()
            self[text] = b
        return b

    def encode(self, text: str) -> bytes:
        """Ids of a text as bytes of int32.

        A single space between two characters that are no white space always begins a pretoken, so the text is cut
        there; where a part touches other white space it is left together with what follows.
        """
        parts = text.split(" ")
        out, held = [], parts[0]
        for p in parts[1:]:
            if p and held and p[0] not in WHITE and held[-1] not in WHITE:
                out.append(held)
                held = " " + p
            else:
                held += " " + p
        out.append(held)
        return b"".join(map(self.__getitem__, out))


@lru_cache(maxsize=2)
def vocabulary_of(path: str) -> tuple[bytes, bytes]:
    """The vocabulary file and the births of its tokens, on the driver."""
    raw = Path(path).read_bytes()
    return raw, Vocabulary(raw).births.tobytes()


@lru_cache(maxsize=2)
def encoder_of(raw: bytes, births: bytes, pattern: str) -> Encoder:
    """A worker's encoder, kept between its tasks."""
    return Encoder(Vocabulary(raw, np.frombuffer(births, np.int32).reshape(2, -1)), pattern)


def encode_table(df: DataFrame, key: str, text: str, ids: bool = True, path: str | None = None, pattern: str = PATTERN, carry: list[str] | None = None) -> DataFrame:
    """``(key, ids)``, or ``(key, n_tokens)`` with ``ids=False``, for every row; ``carry`` columns come along.

    Null and empty texts have no ids: an empty list, never null. Special tokens' strings are ordinary text. Whole texts
    are encoded, however long; repeated rows are encoded each; other columns are not read. The vocabulary (under 1 MB,
    a fixed file) is read on the driver and broadcast. Stages of rows only, no shuffle.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary_of(path or vocabulary_path()))
    keep = [key, *(carry or [])]
    src = df.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_of(*shared.value, pattern)
        for batch in batches:
            cols = [batch.column(i) for i in range(len(keep))]
            # Arrow holds text as UTF-8; what is none there cannot come from Spark
            got = [enc.encode(t) if t else b"" for t in batch.column(len(keep)).to_pylist()]
            size = np.fromiter((len(g) // 4 for g in got), np.int64, len(got))
            if ids:
                ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                out = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(got), dtype=np.int32)))
            else:
                out = pa.array(size)
            yield pa.RecordBatch.from_arrays([*cols, out], [*keep, "ids" if ids else "n_tokens"])

    return src.mapInArrow(run, f"{schema}, " + ("ids array<int>" if ids else "n_tokens bigint"))


def decode_table(df: DataFrame, key: str, ids: str = "ids", path: str | None = None) -> DataFrame:
    """``(key, texto)``: the text that ids stand for; an empty list gives the empty text, null gives null."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary_of(path or vocabulary_path())[0])
    src = df.select(key, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {int(b): base64.b64decode(a) for a, b in (x.split() for x in shared.value.splitlines() if x.strip())}
        for batch in batches:
            texts = [None if x is None else b"".join(map(token.__getitem__, x)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "texto"])

    return src.mapInArrow(run, f"`{key}` {src.schema[key].dataType.simpleString()}, texto string")
