"""Packing by power-of-two decomposition.

A document of L tokens is cut into pieces of the longest allowed length and then into
the binary digits of the rest (2048, 2048, ..., 1024, 64, 1), so every piece has a length
that is a power of two. Pieces of one length form a bucket, and a batch takes sequences
from one bucket. Each piece is a sequence of its own: nothing is padded, and no
sequence crosses documents.

Edge cases: a null or empty text is the end id alone; a document of any length is cut
whole; repeated rows are packed each; extra columns are ignored; an empty table gives
no rows. Sequence ids are unique in one result and ordered within a bucket; they follow from
the partitions of the input, whose rows keep their order when a task is run again.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only_cache, ship

MAX_LENGTH = 2048
#: Words that a worker remembers, in two generations, and four parts of words for every five; about 200 bytes each.
CACHE_WORDS = 500_000
#: Bytes of ids that a worker holds before it hands pieces on.
HELD_BYTES = 4_000_000
PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint, bucket int, ids array<int>"
)


def word_bpe_path() -> str:
    """The vocabulary file that the installed tokenizer package names."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of a text, word by word.

    The pre-tokenizer never joins text across a blank, so ids of the words between blanks,
    put together, are the ids of the text. A word of plain Latin, Greek or Cyrillic letters is
    cut further as the pre-tokenizer cuts it; any other word goes to the tokenizer whole. Each
    different part is encoded once, and two bounded caches remember words and parts.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.room = CACHE_WORDS
        self.cut = regex.compile(json.loads(self.tokenizer.to_str())["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.clear()

    def clear(self) -> None:
        """Forget all words; the previous generation of each cache serves those that come again."""
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.old_parts: dict[str, bytes] = {}

    def _parts_of(self, word: str) -> list[str] | None:
        """The pre-tokenizer's parts, or None where the tokenizer has to see the word itself."""
        if not word.isascii() and (max(word) >= "\u0590" or "\u03a3" in word or "\u0130" in word or not unicodedata.is_normalized("NFC", word)):
            return None
        return None if "<|" in word else self.cut.findall(word.lower())

    def learn(self, words: set[str]) -> None:
        if len(self.words) > self.room // 2:
            self.words, self.old_words = {}, self.words
        if len(self.parts) > self.room * 2 // 5:
            self.parts, self.old_parts = {}, self.parts
        again = {w: self.old_words[w] for w in words if w in self.old_words}
        self.words |= again
        cuts = {w: self._parts_of(w) for w in words if w not in again}
        wanted = {p for w, c in cuts.items() for p in (c if c is not None else [w]) if p not in self.parts}
        self.parts |= {p: self.old_parts[p] for p in wanted if p in self.old_parts}
        new = [p for p in wanted if p not in self.parts]
        for p, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.parts[p] = array("I", e.ids).tobytes()
        for w, c in cuts.items():
            self.words[w] = b"".join([self.parts[p] for p in (c if c is not None else [w])])

    def encode(self, text: str) -> bytes:
        words = text.replace("\n", " ").split(" ")
        try:
            return b"".join([self.words[w] for w in words])
        except KeyError:
            pass
        self.learn({w for w in words if w not in self.words})
        if missing := {w for w in words if w not in self.words}:  # those the cache has let go
            self.learn(missing)
        return b"".join([self.words[w] for w in words])


_ENCODERS: dict[str, WordEncoder] = {}


def encoder_for(path: str) -> WordEncoder:
    """One encoder a Python worker, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def piece_lengths(n: int, longest: int = MAX_LENGTH) -> list[int]:
    """*n* as full pieces and the binary digits of the rest, longest first."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(
    docs: DataFrame, path: str | None = None, longest: int = MAX_LENGTH, end_id: int = 1, with_ids: bool = True, cache_words: int = CACHE_WORDS,
) -> DataFrame:
    """Pieces of *docs*: one row per sequence, with its ids and its bucket (log2 of the length).

    *cache_words* trades a worker's memory for time; ids are the same.
    """
    path = path or word_bpe_path()
    if longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")

    def run(batches):
        encoder, made = encoder_for(path), 0
        encoder.room = cache_words
        base = TaskContext.get().partitionId() << 40
        end = np.array([end_id], dtype="<u4").tobytes()
        only_cache("packing", encoder)

        def out(ids: list, coded: list[bytes]) -> pa.RecordBatch:
            """The pieces of some documents; one buffer holds all ids, in the order of the pieces."""
            nonlocal made
            buffer = b"".join(coded)
            sizes = np.array([len(c) // 4 for c in coded], dtype=np.int64)
            cuts = [piece_lengths(n, longest) for n in sizes.tolist()]
            counts = np.array([len(c) for c in cuts])
            lengths = np.array([x for c in cuts for x in c], dtype=np.int64)
            ends = np.cumsum(lengths)
            starts = ends - lengths - np.repeat(np.cumsum(sizes) - sizes, counts)
            crcs = [zlib.crc32(buffer[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            columns = [
                pa.array(np.repeat(np.array(ids, dtype=object), counts), pa.int64()), pa.array(starts), pa.array(lengths), pa.array(crcs, pa.int64()),
                pa.array(np.repeat(sizes, counts)), pa.array(base + made + np.arange(len(lengths), dtype=np.int64)),
                pa.array(np.zeros(len(lengths), dtype=np.int64)), pa.array(np.log2(lengths).astype(np.int32)),
            ]
            if with_ids:
                offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
                columns.append(pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(buffer, dtype="<i4"))))
            made += len(lengths)
            return pa.record_batch(columns, names[: len(columns)])

        for batch in batches:
            ids, coded, held = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(doc_id)
                coded.append(encoder.encode(text or "") + end)
                held += len(coded[-1])
                if held > HELD_BYTES:
                    yield out(ids, coded)
                    ids, coded, held = [], [], 0
            if ids:
                yield out(ids, coded)

    names = [c.split()[0] for c in PIECES.split(", ")]
    schema = PIECES if with_ids else PIECES.removesuffix(", ids array<int>")
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema)
