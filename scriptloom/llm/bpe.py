"""Byte-level BPE by backtracking over longest matches.

The bytes of a piece are mapped to Latin-1, so that one Aho-Corasick automaton finds the longest vocabulary entry that
starts at each place; the others there are its prefixes, and a table names the next shorter one of each entry. Encoding takes the longest entry that is compatible with the entry before it; where none fits it takes
back the last entry and goes on with the next shorter one, and a place once left is never entered again, so
the work is linear in the length. Two entries are compatible when undoing their merges, the later one first, meets no
earlier merge across the border; the answers are memoised. The ids are those that merging by
rank gives; a piece that is itself an entry is that entry.

Ids travel as binary columns of little-endian unsigned 32-bit integers. Defined results: a null or empty text
has no ids and decodes to no bytes; a piece of any length is one piece; very long texts are encoded whole; an empty table gives no rows and repeated rows each get one; extra columns are kept, and the
output column replaces one of the same name.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptloom.llm.common import read, slices, text_of, tidy

#: Pieces up to this many characters are memoised, up to this many of them; then the memo starts anew.
MEMO_CHARS, MEMO_SIZE = 48, 150_000
#: Compatible or incompatible pairs that are remembered, about 150 bytes each.
PAIR_MEMO = 150_000
#: Bytes of text that are coded at once: texts, ids and decoded bytes of one slice lie in memory together, each as Python objects and in Arrow.
SLICE_BYTES = 512 << 10


class _Memo(dict):
    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        out = self.encode(piece)
        if len(piece) <= MEMO_CHARS:
            self[piece] = out
        return out


class BytePairCodec:
    """Encoder and decoder of one rank file (lines of base64 token and rank, ranks from 0 without gaps)."""

    def __init__(self, rank_file: bytes, pattern: str):
        entries = sorted((int(r), base64.b64decode(t)) for t, r in map(bytes.split, rank_file.splitlines() if rank_file else []))
        if [r for r, _ in entries] != list(range(len(entries))):
            raise ValueError("ranks have gaps")
        self.tokens = [t for _, t in entries]
        self.ranks = {t: r for r, t in entries}
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("not a byte-level vocabulary: single bytes are missing")
        self.split_pattern = regex.compile(pattern)
        self.lengths = [len(t) for t in self.tokens]
        self.parts: list[tuple[int, int]] = []
        self.merged: dict[tuple[int, int], int] = {}
        self.fits: dict[int, bool] = {}  # by first * number of entries + second
        self._undo_merges()
        self.shorter = [next((self.ranks[t[:cut]] for cut in range(len(t) - 1, 0, -1) if t[:cut] in self.ranks), -1) for t in self.tokens]
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(self.tokens):
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.memo = _Memo(self._pack)

    def _undo_merges(self) -> None:
        """The two parts of each entry, in the order of ranks: the only compatible pair of earlier entries."""
        for i, t in enumerate(self.tokens):
            found = (i, i)
            for cut in range(len(t) - 1, 0, -1):
                a, b = self.ranks.get(t[:cut]), self.ranks.get(t[cut:])
                if a is not None and b is not None and a < i and b < i and self._compatible(a, b):
                    found = (a, b)
                    self.merged[found] = i
                    break
            self.parts.append(found)

    def _compatible(self, a: int, b: int) -> bool:
        """Whether merging by rank can leave ``a`` and ``b`` side by side."""
        merged, parts = self.merged, self.parts
        limit = len(self.tokens) + 1
        while True:
            if merged.get((a, b), limit) < limit:
                return False
            if a > b:
                limit, a = a, parts[a][1]
                if a == limit:
                    limit, b = b + 1, parts[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, parts[b][0]
                if b + 1 == limit:
                    limit, a = a, parts[a][1]
                    if a == limit:
                        return True

    def encode_piece(self, raw: bytes) -> list[int]:
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        if not raw:
            return []
        lengths, fits, shorter, many = self.lengths, self.fits, self.shorter, len(self.tokens)
        if len(fits) > PAIR_MEMO:
            fits.clear()
        n = len(raw)
        longest = array("i", bytes(4 * n))  # of each place; the shorter ones are its prefixes
        for end, i in self.automaton.iter(raw.decode("latin-1")):
            longest[end - lengths[i] + 1] = i  # of one start, the longest comes last
        at, last, out, closed = 0, -1, [], None
        token = longest[0]
        while True:
            while token >= 0:
                if closed is None or not closed[at + lengths[token]]:
                    if last < 0:
                        break
                    fit = fits.get(last * many + token)
                    if fit is None:
                        fit = fits[last * many + token] = self._compatible(last, token)
                    if fit:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += lengths[token]
                if at == n:
                    return out
                last, token = token, longest[at]
            else:  # no entry fits here: never come back, and shorten the one before
                if closed is None:
                    closed = bytearray(n + 1)
                closed[at] = 1
                at -= lengths[last]
                token = shorter[out.pop()]
                last = out[-1] if out else -1

    def _pack(self, piece: str) -> bytes:
        ids = self.encode_piece(piece.encode("utf-8", "surrogatepass"))
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Ids of the text as little-endian unsigned 32-bit integers."""
        if len(self.memo) > MEMO_SIZE:
            self.memo.clear()
        return b"".join(map(self.memo.__getitem__, self.split_pattern.findall(text)))

    def forget(self) -> None:
        """Drop what was memoised; the worker lives on after the task."""
        self.memo.clear()
        self.fits.clear()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_CODECS: dict[str, BytePairCodec] = {}


def codec_of(rank_file: bytes, pattern: str) -> BytePairCodec:
    """One codec per worker process and vocabulary."""
    key = hashlib.sha256(rank_file + pattern.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = BytePairCodec(rank_file, pattern)
    return _CODECS[key]


def _mapped(df: DataFrame, source: str, out: str, work, kind: str) -> DataFrame:
    kept = [c for c in df.columns if c != out]
    rows = df.select(F.col(source).cast(kind).alias("\x00in"), *kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = work()
        for b in slices(batches, 0, SLICE_BYTES):
            got = pa.array([f(x) for x in b.column(0).to_pylist()], type=pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], got], names=[*kept, out])

    return rows.mapInArrow(tidy(run), T.StructType([*rows.schema.fields[1:], T.StructField(out, T.BinaryType())]))


def _vocabulary(df: DataFrame, path: str, pattern: str):
    with open(path, "rb") as f:  # on the driver; workers get it by broadcast, of the size of the vocabulary
        return df.sparkSession.sparkContext.broadcast((f.read(), pattern))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with the ids of every text in the binary column ``out``."""
    v = _vocabulary(df, path, pattern)

    def work():
        codec = codec_of(*v.value)
        return lambda t: codec.encode(t) if t else b""

    return _mapped(df, text, out, work, "string")


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes of every id list in the binary column ``out``."""
    v = _vocabulary(df, path, pattern)

    def work():
        codec = codec_of(*v.value)
        return lambda x: codec.decode(x) if x else b""

    return _mapped(df, ids, out, work, "binary")


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, with ``ids`` and ``decoded``: both steps in one worker, with one vocabulary in memory."""
    v = _vocabulary(docs, path, pattern)
    kept = [c for c in docs.columns if c not in (text, "ids", "decoded")]
    rows = docs.select(F.col(text).cast("string").alias("\x00in"), *kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(*v.value)
        for b in slices(batches, 0, SLICE_BYTES):
            ids = [codec.encode(t) if t else b"" for t in b.column(0).to_pylist()]
            both = [pa.array(ids, type=pa.binary()), pa.array([codec.decode(x) for x in ids], type=pa.binary())]
            del ids  # one slice at a time
            out = pa.RecordBatch.from_arrays([*b.columns[1:], *both], names=[*kept, "ids", "decoded"])
            del both
            yield out
            del out
        codec.forget()

    added = [T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())]
    return rows.mapInArrow(tidy(run), T.StructType([*rows.schema.fields[1:], *added]))


def digests(df: DataFrame) -> DataFrame:
    return df.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", text_of().alias("text"))
    return digests(round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))
