"""Byte-level BPE encoding of a corpus with a public vocabulary, merging by a segment tree."""

from __future__ import annotations

import base64
import importlib.util
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folder of the public vocabularies (see its README); a parameter of every function here.
TOKENIZER_DIR = "/opt/tokenizers"
#: Pieces a worker remembers before it starts afresh.
CACHE_PIECES = 1 << 18

_NONE = 1 << 60


def load_ranks(name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> tuple[str, dict[bytes, int]]:
    """The pattern that splits text into pieces, and the rank (also the id) of every byte string of the vocabulary."""
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    spec = importlib.util.spec_from_file_location("public_tokenizers", f"{folder}/__init__.py")
    public_tokenizers = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(public_tokenizers)
    return public_tokenizers.PATTERN, ranks


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece. Leaf i of the tree holds the rank of the pair that starts at byte i, if one starts there.

    The root is the lowest rank and, going down left first, its leftmost pair. A merge changes three leaves, each by a
    walk to the root, until the root has no pair left: O(n log n) for any piece.
    """
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    size = 1 << (n - 1).bit_length()
    tree = [_NONE] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        tree[size + i] = get(piece[i : i + 2], _NONE)
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a <= b else b
    after = list(range(1, n + 1))
    before = list(range(-1, n))

    def put(i: int, rank: int) -> None:
        i += size
        tree[i] = rank
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            least = a if a <= b else b
            if tree[i] == least:
                return
            tree[i] = least
            i >>= 1

    while (best := tree[1]) != _NONE:
        i = 1
        while i < size:
            i *= 2
            if tree[i] != best:
                i += 1
        i -= size
        j = after[i]
        end = after[j]
        after[i] = end
        if end < n:
            before[end] = i
        put(j, _NONE)
        put(i, get(piece[i : after[end]], _NONE) if end < n else _NONE)
        p = before[i]
        if p >= 0:
            put(p, get(piece[p:end], _NONE))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


def text_encoder(pattern: str, ranks: dict[bytes, int]) -> Callable[[str | None], list[int]]:
    """Whole texts to ids; null and empty texts give no ids. Pieces that recur are merged once."""
    pieces = regex.compile(pattern).findall
    cache: dict[str, list[int]] = {}

    def encode(text: str | None) -> list[int]:
        ids: list[int] = []
        if not text:
            return ids
        for piece in pieces(text):
            found = cache.get(piece)
            if found is None:
                if len(cache) >= CACHE_PIECES:
                    cache.clear()
                found = merge_piece(piece.encode("utf-8"), ranks)
                if len(piece) <= 64:
                    cache[piece] = found
            ids += found
        return ids

    return encode


def _udf(spark: SparkSession, name: str, folder: str, kind: str):
    # 50 thousand entries by definition of the vocabulary, whatever the corpus
    shared = spark.sparkContext.broadcast(load_ranks(name, folder))

    def lists(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = text_encoder(*shared.value)
        for texts in batches:
            found = [np.asarray(encode(t), dtype=np.int32) for t in texts.to_pylist()]
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            flat = np.concatenate(found) if found else np.zeros(0, dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))

    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = text_encoder(*shared.value)
        for texts in batches:
            yield pa.array([len(encode(t)) for t in texts.to_pylist()], pa.int64())

    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from lists(batches)

    def sizes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from counts(batches)

    return F.arrow_udf(ids, "array<int>") if kind == "ids" else F.arrow_udf(sizes, "bigint")


def encode_corpus(
    df: DataFrame, text: str = "text", out: str = "ids", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR
) -> DataFrame:
    """Adds `out`: the list of token ids of each text, without special tokens.

    Null and empty texts give an empty list, never null. Strings that other systems use as markers are ordinary text.
    Texts are read whole, in place: there is no shuffle, repeated rows stay, other columns pass through untouched, and
    a column that is already called `out` is replaced. An empty table gives an empty table.
    """
    return df.withColumn(out, _udf(df.sparkSession, tokenizer, folder, "ids")(F.col(text)))


def token_count(
    df: DataFrame, text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR
) -> Column:
    """A column with the number of tokens of each text (0 for null and empty ones), without building the lists."""
    return _udf(df.sparkSession, tokenizer, folder, "count")(F.col(text))
