"""Problem 8: encoding of the whole corpus with a public tokenizer, by a monoid tree reduction.

The exact encoding of a text is a monoid element: the token ids plus the starts of the pre-tokens. Two
neighbours join by encoding a window across their border again and growing it until both ends are provably
stable; every token outside the window is taken over as it is. The proof rests on how byte-level BPE splits a
text: its pattern scans left to right without look-behind and looks at most LOOKAHEAD characters past the end of
a pre-token, and merges never cross pre-tokens. So

* a pre-token of the left part that ends LOOKAHEAD or more characters before the border is the same in the
  joined text, as everything its match looked at lies in the left part;
* from any position that starts a pre-token both in the joined text and in the right part alone, the two scans
  are the same, as the scan keeps no memory of what came before.

Every text is halved recursively down to leaves of at most LEAF characters, which is below the common length of a
text. The leaves of many texts are encoded in one batch and joined pairwise up each text's tree, so the library never
sees a text longer than a leaf or a window. Decoding concatenates bytes up the same kind of tree.

The proof holds for a vocabulary that splits by the byte-level pattern without normalising first. ``splits_stably``
reads that from the vocabulary file; with any other file a text is a single leaf, which is exact for every tokenizer.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.sources.tables import table

VOCABULARIES = "/opt/tokenizers"
#: Most characters of a leaf.
LEAF = 256
#: Characters past the end of a pre-token that its match may depend on (contractions look at two).
LOOKAHEAD = 3
#: First window on either side of a border; doubled until stable.
WINDOW = 24
#: Characters handed to the library at once.
BATCH_CHARS = 2_000_000


@lru_cache(maxsize=4)
def load(vocabulary: str):
    """The tokenizer in ``vocabulary``, one per worker process; special tokens' strings are ordinary text."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    tokenizer.encode_special_tokens = True
    return tokenizer


@lru_cache(maxsize=4)
def splits_stably(vocabulary: str) -> bool:
    """Whether the tokenizer in ``vocabulary`` splits as the proof of the joins demands."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    split = spec.get("pre_tokenizer") or {}
    return spec.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)


@dataclass
class Piece:
    """The exact encoding of a text taken alone: ids, and for each pre-token its start and its first token."""

    text: str
    ids: list[int]
    starts: list[int]
    firsts: list[int]


def _piece(text: str, encoding) -> Piece:
    words, offsets = encoding.word_ids, encoding.offsets
    firsts = [k for k, (word, last) in enumerate(zip(words, [-1, *words])) if word != last]  # noqa: B905
    return Piece(text, encoding.ids, [offsets[k][0] for k in firsts], firsts)


def encode_piece(tokenizer, text: str) -> Piece:
    return _piece(text, tokenizer.encode(text, add_special_tokens=False))


def join(tokenizer, left: Piece, right: Piece) -> Piece:
    """The exact encoding of ``left.text + right.text``."""
    if not left.text or not right.text:
        return left if left.text else right
    n = len(left.text)
    # the last pre-token start of the left part before which all is stable; 0 always is
    i = max(0, bisect_right(left.starts, n - LOOKAHEAD) - 1) if left.starts else 0
    begin = left.starts[i] if left.starts and left.starts[i] <= n - LOOKAHEAD else 0
    keep = left.firsts[i] if begin else 0
    # no window short of the right part's second pre-token can be stable
    tail, reach = left.text[begin:], max(WINDOW, right.starts[1] + LOOKAHEAD if len(right.starts) > 1 else len(right.text))
    while True:
        end = min(len(right.text), reach)
        window = encode_piece(tokenizer, tail + right.text[:end])
        whole = end == len(right.text)
        if not whole:
            # the first start in the window that is also a start of the right part, far enough from the window's end
            for j in range(bisect_left(window.starts, len(tail)), len(window.starts)):
                at = window.starts[j] - len(tail)
                if at > end - LOOKAHEAD:
                    break
                r = bisect_left(right.starts, at)
                if r < len(right.starts) and right.starts[r] == at:
                    return _glue(left, right, begin, keep, i if begin else 0, window, j, r)
            reach *= 2
            continue
        return _glue(left, right, begin, keep, i if begin else 0, window, len(window.starts), len(right.starts))


def _glue(left: Piece, right: Piece, begin: int, keep: int, words: int, window: Piece, j: int, r: int) -> Piece:
    """Left up to ``begin``, the window up to its pre-token ``j``, the right part from its pre-token ``r`` on."""
    n = len(left.text)
    middle = window.firsts[j] if j < len(window.starts) else len(window.ids)
    rest = right.firsts[r] if r < len(right.starts) else len(right.ids)
    shift = keep + middle - rest
    return Piece(
        left.text + right.text,
        left.ids[:keep] + window.ids[:middle] + right.ids[rest:],
        left.starts[:words] + [begin + s for s in window.starts[:j]] + [n + s for s in right.starts[r:]],
        left.firsts[:words] + [keep + f for f in window.firsts[:j]] + [shift + f for f in right.firsts[r:]],
    )


def reduce_tree(tokenizer, leaves: list[Piece]) -> Piece:
    """Join neighbours, halving the number of pieces at each level."""
    while len(leaves) > 1:
        leaves = [join(tokenizer, *leaves[k : k + 2]) if k + 1 < len(leaves) else leaves[k] for k in range(0, len(leaves), 2)]
    return leaves[0]


def halves(text: str, leaf: int) -> list[str]:
    """The leaves of a text: halved again and again until none has more than ``leaf`` characters."""
    count = 1
    while -(-len(text) // count) > leaf:
        count *= 2
    return [text[len(text) * k // count : len(text) * (k + 1) // count] for k in range(count)] if count > 1 else [text]


def encode_texts(tokenizer, texts: list[str], leaf: int = LEAF) -> Iterator[list[int]]:
    """The ids of each text in turn, every text through its tree."""
    k = 0
    while k < len(texts):
        parts: list[str] = []
        spans: list[tuple[int, int]] = []
        size = 0
        while k < len(texts) and (size < BATCH_CHARS or not spans):
            first = len(parts)
            parts += halves(texts[k], leaf)
            spans.append((first, len(parts)))
            size += len(texts[k])
            k += 1
        encodings = tokenizer.encode_batch(parts, add_special_tokens=False)
        for a, b in spans:
            yield encodings[a].ids if b - a == 1 else reduce_tree(tokenizer, [_piece(parts[x], encodings[x]) for x in range(a, b)]).ids


def encode_corpus(df: DataFrame, key: str, text: str, vocabulary: str = f"{VOCABULARIES}/byte_bpe_50k.json", leaf: int = LEAF) -> DataFrame:
    """(key, ids ARRAY<INT>) of every row, in the rows' own partitions: no shuffle, text column and key only.

    Defined cases: an empty and a null text give an empty list; the text is taken exactly as stored (no
    normalisation, strings of special tokens are ordinary text); texts of any length are encoded whole;
    repeated rows are encoded each; a null key is kept; an empty table gives no rows; extra columns are dropped.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            arrays = [np.asarray(ids, dtype=np.int32) for ids in encode_texts(tokenizer, texts, leaf if splits_stably(vocabulary) else max(map(len, texts), default=1) + 1)]
            offsets = np.zeros(len(arrays) + 1, dtype=np.int32)
            np.cumsum([len(a) for a in arrays], out=offsets[1:])
            values = np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=[key, "ids"])

    return df.select(F.col(key), F.col(text).alias("text" if key != "text" else "body")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(df: DataFrame, key: str, text: str, vocabulary: str = f"{VOCABULARIES}/byte_bpe_50k.json") -> DataFrame:
    """(key, n_tokens INT) of every row; 0 for an empty or null text."""
    return encode_corpus(df, key, text, vocabulary).select(key, F.size("ids").alias("n_tokens"))


def decode_corpus(df: DataFrame, key: str, ids: str, vocabulary: str = f"{VOCABULARIES}/byte_bpe_50k.json") -> DataFrame:
    """(key, text) of every row: the inverse of ``encode_corpus``. Null ids give a null text, an empty list an empty text.

    Bytes are concatenated up the tree before they are read as UTF-8, as one character can span tokens.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _token_bytes(vocabulary)
        for batch in batches:
            texts = [None if x is None else decode_tree(tokens, x).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return df.select(F.col(key), F.col(ids).alias("ids")).mapInArrow(run, f"`{key}` {kind}, text string")


def decode_tree(tokens: list[bytes], ids: list[int]) -> bytes:
    """The bytes of ``ids``: those of its halves, one after the other."""
    if len(ids) <= LEAF:
        return b"".join([tokens[i] for i in ids])
    middle = len(ids) // 2
    return decode_tree(tokens, ids[:middle]) + decode_tree(tokens, ids[middle:])


@lru_cache(maxsize=2)
def _token_bytes(vocabulary: str) -> list[bytes]:
    """The bytes of each id, undoing the byte-to-character map of byte-level BPE."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    to_byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}
    vocab = load(vocabulary).get_vocab()
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
    return out


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and ids of every document by byte_bpe_50k, without special tokens."""
    return encode_corpus(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def p8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, and whether decoding its ids gives back its text (null as empty)."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    back = decode_corpus(encode_corpus(docs, "doc_id", "text"), "doc_id", "ids").withColumnRenamed("text", "decoded")
    return docs.join(back, "doc_id").select("doc_id", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("same"))


QUERIES = {"p8_ids": p8_ids, "p8_roundtrip": p8_roundtrip}
ORACLES = {"p8_roundtrip": "SELECT doc_id, true AS same FROM documents"}
