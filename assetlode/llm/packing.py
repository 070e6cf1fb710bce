"""Packing documents into fixed-length sequences along a Hilbert curve.

Every text is tokenised once; its ids are hashed into a vector of few
dimensions, the vectors are standardised over the corpus, and each document gets
its key on a Hilbert curve. Documents are range-sorted by that key and laid end
to end, so that neighbours on the curve share sequences and only the very last
sequence can be short.

Defined results: a null text is an empty one, which still has its end id;
documents with equal keys follow by doc_id (null first); repeated rows are packed
each; an empty table gives no rows; columns other than ``doc_id`` and ``text``
are ignored.
"""

from __future__ import annotations

import functools
import os
import re
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlode.llm.arrow import kept_by_workers, longs, map_rows
from assetlode.llm.bpe import byte_letters
from assetlode.llm.memo import Memo
from assetlode.llm.ranking import running_total
from assetlode.plans.staging import materialize

SEQUENCE = 2048
END_ID = 1
DIMS, BITS, SEED = 4, 10, 20
#: Words, and pieces of words, in one generation of a memo.
MEMO_WORDS = 500_000
#: Texts that are split together; longer ones than a run are runs of their own.
RUN_ROWS, RUN_BYTES = 2_000, 1 << 24
#: White space on which libraries differ, or which is rare; texts with it take the tokenizer's own path.
UNUSUAL_SPACE = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]")
#: Words whose normal form is lower case only, in every version of Unicode.
PLAIN = re.compile(r"[\x21-\x7e\xa1-\u012f\u0131-\u024f]+")
#: Marks that end words and are one piece together.
MARKS = ".,;:!?\"()*#"
# Fixed value: how the tokenizer splits a word.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


class WordEncoder:
    """A tokenizer that drops white space, with the ids of words and of their pieces kept: most are encoded once a worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenize = self.tokenizer.model.tokenize
        self.letters = dict(enumerate(byte_letters()))
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.code = "H" if self.dtype == "<u2" else "I"
        self.words, self.pieces = Memo(self._word), Memo(self._piece)

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _piece(self, piece: str) -> bytes:
        """The ids of a piece in normal form, straight from the merges."""
        letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.tokenize(letters)]).tobytes()

    def _word(self, word: str) -> bytes:
        """The ids of a word: by pieces if it is plain, else by the tokenizer's own preparation."""
        if not (word.isprintable() if word.isascii() else PLAIN.fullmatch(word)) or any(a in word for a in self.added):
            return array(self.code, self._whole(word)).tobytes()
        word = word.lower()
        if word.isalpha():
            return self.pieces[word]
        stem = word.rstrip(MARKS)
        if stem.isalpha():
            return self.pieces[stem] + self.pieces[word[len(stem) :]]
        return b"".join([self.pieces[p] for p in SPLIT.findall(word)])

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; a run of texts is split at once, and each of its distinct words is looked up once."""
        out: list[np.ndarray] = []
        heavy = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // RUN_BYTES
        starts = [0, *(np.flatnonzero(heavy[1:] != heavy[:-1]) + 1).tolist(), len(texts)] if len(texts) else [0]
        for a, z in zip(starts[:-1], starts[1:]):
            out += self._run(texts.slice(a, z - a))
        return out

    def _run(self, texts: pa.Array) -> list[np.ndarray]:
        self.words, self.pieces = self.words.trimmed(MEMO_WORDS), self.pieces.trimmed(MEMO_WORDS)
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        known = list(map(self.words.__getitem__, words.dictionary.to_pylist()))
        flat = np.frombuffer(b"".join(known), dtype=self.dtype)
        sizes = np.fromiter(map(len, known), dtype=np.int64, count=len(known)) // flat.itemsize
        first = np.cumsum(sizes) - sizes
        which = words.indices.to_numpy()
        ends = np.cumsum(sizes[which])
        at = np.repeat(first[which] - ends + sizes[which], sizes[which]) + np.arange(ends[-1] if len(ends) else 0)
        cuts = np.concatenate([[0], ends])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        ids = flat[at]
        out = [ids[a:z] for a, z in zip(cuts[:-1], cuts[1:])]
        for k in np.flatnonzero(pc.match_substring_regex(texts, UNUSUAL_SPACE.pattern).to_numpy(zero_copy_only=False)).tolist():
            out[k] = np.array(self._whole(texts[k].as_py()), dtype=self.dtype)
        return out


@kept_by_workers
@functools.lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


@functools.lru_cache(maxsize=1)
def projection() -> np.ndarray:
    """For each dimension a normal number for each hashed token id."""
    return np.random.default_rng(SEED).standard_normal((DIMS, 1 << 16)).astype(np.float32)


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Keys on the Hilbert curve of integer points (n, dims), by Skilling's transposition."""
    x = [c.astype(np.int64) for c in points.T]
    dims, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, dims):
        x[i] = x[i] ^ x[i - 1]
    turn, q = np.zeros_like(x[0]), top
    while q > 1:
        turn = np.where((x[-1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | (((x[i] ^ turn) >> b) & 1)
    return key


def tokenise(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """row, doc_id, n, ids (little-endian, two bytes an id where they suffice) and the projected vector c0, c1, ..."""
    id_type = dict(docs.dtypes)["doc_id"]

    def run(part: pa.RecordBatch) -> dict:
        encoder, axes = word_encoder(tokenizer_path), projection()
        ids = [np.append(a, np.array([END_ID], dtype=a.dtype)) for a in encoder.encode(part.column("text"))]
        vectors = np.array([[axis.take(a).sum() / len(a) for axis in axes] for a in (a.astype(np.intp) & 0xFFFF for a in ids)], dtype=np.float64)
        out = {"row": part.column("row"), "doc_id": part.column("doc_id"), "n": longs([len(a) for a in ids]), "ids": pa.array([a.tobytes() for a in ids], pa.binary())}
        return out | {f"c{i}": pa.array(vectors[:, i]) for i in range(DIMS)}

    source = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return map_rows(source, run, f"row long, doc_id {id_type}, n long, ids binary, " + ", ".join(f"c{i} double" for i in range(DIMS)), rows=RUN_ROWS)


def curve_order(tokens: DataFrame) -> DataFrame:
    """row and the place of its first id when all documents are laid along the curve."""
    axes = [f"c{i}" for i in range(DIMS)]
    stats = tokens.agg(*[F.avg(c) for c in axes], *[F.stddev_pop(c) for c in axes]).first()
    means = np.array([stats[i] or 0.0 for i in range(DIMS)])
    spreads = np.array([stats[DIMS + i] or 1.0 for i in range(DIMS)])

    @F.pandas_udf("long")
    def key(*columns: pd.Series) -> pd.Series:
        z = (np.stack([c.to_numpy() for c in columns], axis=1) - means) / spreads
        cells = np.clip((z + 3) / 6 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
        return pd.Series(hilbert_keys(cells, BITS))

    keyed = tokens.select("row", "doc_id", "n", key(*axes).alias("key"))
    return running_total(keyed, ["key", "doc_id", "row"], ["row"], "n", "place")


def pack(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE) -> DataFrame:
    """Pieces: doc_id, start, length, ids (unsigned little-endian 32-bit), doc_tokens, sequence_id, offset."""
    id_type = dict(docs.dtypes)["doc_id"]
    tokens = materialize(tokenise(docs, tokenizer_path), "token-ids", compression="zstd")

    def cut(part: pa.RecordBatch) -> dict:
        dtype = word_encoder(tokenizer_path).dtype
        out, raws = [], []
        for k, (raw, n, place) in enumerate(zip(*(part.column(c).to_pylist() for c in ("ids", "n", "place")))):
            ids = np.frombuffer(raw, dtype=dtype).astype("<u4")
            start = 0
            while start < n:
                offset = (place + start) % sequence
                length = min(n - start, sequence - offset)
                out.append((k, start, length, n, (place + start) // sequence, offset))
                raws.append(ids[start : start + length].tobytes())
                start += length
        which, start, length, n, sequence_id, offset = (longs(c) for c in zip(*out))
        return {"doc_id": part.column("doc_id").take(which), "start": start, "length": length, "ids": pa.array(raws, pa.binary()),
                "doc_tokens": n, "sequence_id": sequence_id, "offset": offset}

    places = curve_order(tokens)
    placed = tokens.select("row", "doc_id", "n", "ids").join(places.hint("shuffle_hash"), "row").select("doc_id", "n", "ids", "place")
    return map_rows(placed, cut, f"doc_id {id_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
