"""Packing documents into training sequences along a space-filling curve.

1. Every whole text is tokenized once. Its ids are counted into a hashed vector, which a
   fixed random matrix projects to a few dimensions; the place of that point on a Hilbert
   curve is the document's key. Ids and keys are written.
2. Keys and lengths alone are range-sorted. Running sums, inside ranges and over the sums
   of ranges, give each document the place of its first id in one long stream.
3. The stream is cut every `length` ids. Ids join their places by row, and each document
   yields its own pieces; no task sees more than documents one by one.

So neighbours on the curve share sequences, each id lies in one piece, and only the last
sequence is short of `length`.

Defined cases: a null text counts as an empty one and has the end id alone; repeated rows
are packed each; ties of keys follow the row's number; a text longer than a sequence fills
several; an empty table gives no pieces. Other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Scratch
from .text import text_or_empty, through_pandas


@dataclass(frozen=True)
class Params:
    tokenizer: str = ""
    """Path of the vocabulary file; empty: the public word-level BPE of 49k ids."""
    length: int = 4096
    end_id: int = 2
    dims: int = 3
    bits: int = 16
    hashed: int = 256
    range_rows: int = 50_000
    cached_words: int = 300_000


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if not path:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return Tokenizer.from_file(path)


#: The steps of the public vocabulary before its merges, as `_words` repeats them for plain words.
_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
    "padding": None,
}
_LETTERS = "a-z\u00df-\u00f6\u00f8-\u00ff"
_PLAIN = "[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")


class _Kept(dict):
    """What `make` gives for each key; for keys met more than once it is kept, up to a bound."""

    def __init__(self, make: Callable[[str], bytes], bound: int) -> None:
        self.make, self.bound, self.met = make, bound, bytearray(1 << 23)

    def __missing__(self, key: str) -> bytes:
        out = self.make(key)
        at = hash(key) & 0x7FFFFF
        if not self.met[at]:
            self.met[at] = 1
        elif len(self) < self.bound:
            self[key] = out
        return out


@lru_cache(maxsize=1)
def _words(path: str, bound: int) -> _Kept:
    """Ids of words, as little-endian 32-bit numbers, and those of their pieces.

    A plain word has only printable ASCII and the letters of Latin-1, which are in form NFC
    and lower-cased one by one. It is cut into pieces here, by the vocabulary's own pattern,
    and new pieces go to the merges. All other words, and all words under other steps, take
    the tokenizer's whole way.
    """
    from tokenizers import pre_tokenizers

    whole = _tokenizer(path)
    steps = json.loads(whole.to_str())
    merged = whole.model.tokenize
    level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    bytes_of = {k: level.pre_tokenize_str(chr(k))[0][0] for k in range(0xDF, 0x100)}
    little = [k.to_bytes(4, "little") for k in range(whole.get_vocab_size())]

    def of_piece(piece: str) -> bytes:
        return b"".join([little[t.id] for t in merged(piece if piece.isascii() else piece.translate(bytes_of))])

    def of_any(word: str) -> bytes:
        return np.array(whole.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    # an added token may begin inside a word
    begins = "".join({re.escape(t.content[0]) for t in whole.get_added_tokens_decoder().values()})
    plain = re.compile(f"(?!.*[{begins}]){_PLAIN}" if begins else _PLAIN).fullmatch
    pieces, cut = _Kept(of_piece, bound).__getitem__, _PIECES.findall

    def of_word(word: str) -> bytes:
        if not plain(word):
            return of_any(word)
        low = word.lower()
        return pieces(low) if low.isascii() and low.isalpha() else b"".join(map(pieces, cut(low)))

    return _Kept(of_word if {k: steps[k] for k in _STEPS} == _STEPS else of_any, bound)


def _encoded(texts: list[str], p: Params) -> Iterator[bytes]:
    """Ids of each text, with the end id.

    The vocabulary drops white space and no token spans it, so the ids of a text are those
    of its words in order, and words met before needn't be encoded again.
    """
    of = _words(p.tokenizer, p.cached_words).__getitem__
    end = np.array([p.end_id], "<u4").tobytes()
    for text in texts:
        yield b"".join(map(of, text.replace("\n", " ").split(" "))) + end


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Keys of integer points, shape (n, dims), on the Hilbert curve of that many bits an axis.

    Works on all points at once: from the highest bit down, axes are exchanged or inverted
    so that each cube is entered as the curve asks, then the bits are Gray-decoded.
    """
    x = points.astype(np.uint64).copy()
    n, dims = x.shape
    for b in range(bits - 1, 0, -1):
        bit, below = np.uint64(1 << b), np.uint64((1 << b) - 1)
        for i in range(dims):
            on = (x[:, i] & bit) != 0
            swap = np.where(on, np.uint64(0), (x[:, 0] ^ x[:, i]) & below)
            x[:, 0] ^= np.where(on, below, swap)
            x[:, i] ^= swap
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(n, np.uint64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[:, dims - 1] & np.uint64(1 << b)) != 0, np.uint64((1 << b) - 1), np.uint64(0))
    x ^= flip[:, None]
    key = np.zeros(n, np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << np.uint64(1)) | ((x[:, i] >> np.uint64(b)) & np.uint64(1))
    return key.astype(np.int64)


def _keys(encoded: list[bytes], p: Params) -> np.ndarray:
    counts = np.zeros((len(encoded), p.hashed))
    for k, ids in enumerate(encoded):
        hashed = (np.frombuffer(ids, "<u4") * np.uint32(2654435761)) >> np.uint32(16)
        counts[k] = np.bincount(hashed % p.hashed, minlength=p.hashed)
    counts = np.sqrt(counts)
    counts /= np.linalg.norm(counts, axis=1, keepdims=True)
    spread = np.random.default_rng(7).normal(size=(p.hashed, p.dims))
    spread -= spread.mean(axis=0)  # takes out what all documents share
    point = np.clip((counts @ spread + 4) / 8, 0, 1)
    return hilbert((point * (2**p.bits - 1)).astype(np.int64), p.bits)


def tokenize(docs: DataFrame, p: Params) -> DataFrame:
    """(row, doc_id, ids, n, key) of (row, doc_id, text); ids are little-endian 16-bit numbers if the vocabulary allows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at : at + 512]
                encoded = list(_encoded(list(part["text"]), p))
                yield pd.DataFrame({"row": part["row"].to_numpy(), "doc_id": part["doc_id"].to_numpy(), "ids": [_narrow(x) for x in encoded], "n": [len(x) // 4 for x in encoded], "key": _keys(encoded, p)})

    return through_pandas(docs, run, "row long, ids binary, n long, key long")


def _narrow(ids: bytes) -> bytes:
    """16-bit numbers behind a zero byte if all fit, else the 32-bit ones behind a one."""
    wide = np.frombuffer(ids, "<u4")
    return b"\0" + wide.astype("<u2").tobytes() if wide.max() < 65536 else b"\1" + ids


def _wide(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u4" if ids[0] else "<u2", offset=1).astype("<u4")


def places(tokens: DataFrame, scratch: Scratch, p: Params) -> DataFrame:
    """(row, start): where each row's first id lies in the stream along the curve."""
    n = max(1, -(-tokens.count() // p.range_rows))
    ranged = tokens.select("row", "n", "key").repartitionByRange(n, "key", "row").withColumn("range", F.spark_partition_id())
    ranged = scratch.save(ranged)
    ranges = ranged.groupBy("range").agg(F.sum("n").alias("sum"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("range", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))  # a row for each range
    inside = Window.partitionBy("range").orderBy("key", "row").rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(ranges, "range").select("row", (F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("start"))


def pack(df: DataFrame, p: Params = Params(), key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece; ids too if asked for."""
    scratch = Scratch(df.sparkSession, "packing")
    docs = df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc_id"), text_or_empty(text).alias("text"))
    tokens = scratch.save(tokenize(docs, p))
    placed = tokens.select("row", "doc_id", "ids", "n").join(places(tokens, scratch, p), "row")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, ids, n, start in zip(batch["doc_id"], batch["ids"], batch["n"], batch["start"], strict=True):
                wide, at = _wide(ids), 0
                while at < n:
                    sequence, offset = divmod(start + at, p.length)
                    size = min(n - at, p.length - offset)
                    piece = wide[at : at + size].tobytes()
                    rows.append((doc_id, at, size, zlib.crc32(piece), n, sequence, offset) + ((piece,) if with_ids else ()))
                    at += size
            yield pd.DataFrame(rows, columns=columns)

    schema = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    columns = ["doc_id", *(x.split()[0] for x in schema.split(", "))]
    return through_pandas(placed.select("doc_id", "ids", "n", "start"), run, schema)
