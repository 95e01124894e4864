"""Encoding and decoding with a SentencePiece vocabulary as joins over a lattice of substrings.

Encoding:
1. Texts are cut into words: a blank (as the vocabulary's mark) starts a word, and no piece of the
   vocabulary crosses a cut, since the two letters at it stand side by side in no piece.
2. Each different word of the corpus is exploded into its substrings of bounded length, which
   are equi-joined to the piece table: the lattice. The table is broadcast; it has as many rows as the
   vocabulary. Edges are grouped by word in the stage that made them, without a shuffle.
3. A higher-order ``aggregate`` folds each word's edges into its pieces.
4. Words meet the documents in blocks, stretches of the input partitions: every block receives the words it uses.

The fold: a unigram vocabulary takes the Viterbi path (``fold="viterbi"``). The given vocabulary
is BPE, for which the best sum of scores is not the library's answer; its edges are folded in order of
score, each one merging two neighbours if exactly two stand there (``fold="bpe"``), which is
what merging does as long as pieces are learned after their parts.

Decoding looks ids up in the piece table and puts the pieces together by position.

Edge cases: null and empty texts have no ids and decode to the empty text; letters outside the vocabulary
become byte pieces, or the unknown piece where there are none; words longer than ``LONGEST`` letters
are merged in a task with a heap instead of the fold; repeated rows repeat; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, ship, stored

MARK = "▁"
LONGEST = 256
BLOCK_CHARS = 16_000_000
PARTITION_CHARS = 4_000_000
#: Words whose edges are grouped in memory; a partition with more is sorted instead.
GROUPED_WORDS = 50_000
#: Words a task remembers before it hands them on; bounds its memory.
HELD_WORDS = 1_000_000


def piece_path() -> str:
    """The vocabulary file that the installed tokenizer package names."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """The pieces of a model file, and where texts may be cut."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.unknown = model.unk_id()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(size)]
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.pieces = {model.id_to_piece(i): (i, float(model.get_score(i))) for i in range(size) if not special[i] and not model.is_byte(i)}
        self.names = [model.id_to_piece(i) for i in range(size)]
        self.silent = [bool(s) for s in special]
        self.longest = max(map(len, self.pieces))
        pairs = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        # A run of letters each two of which stand side by side in some piece.
        follow: dict[str, list[str]] = {}
        for a, b in pairs:
            follow.setdefault(a, []).append(b)
        self.follow = {a: frozenset(bs) for a, bs in follow.items()}
        letters = "".join(sorted({c for p in self.pieces for c in p} - {MARK}))
        self.rough = re.compile(f"{MARK}+[{re.escape(letters)}]*|[{re.escape(letters)}]+|.", re.S)

    def words(self, text: str | None) -> list[str]:
        """The words of *text* in order; put together they are the normalised text."""
        if not text:
            return []
        return self.rough.findall(MARK + text.replace(" ", MARK))

    def parts(self, word: str) -> list[str]:
        """*word* cut where two letters stand side by side in no piece."""
        out, start, follow = [], 0, self.follow
        for i in range(1, len(word)):
            if word[i] not in follow.get(word[i - 1], ()):
                out.append(word[start:i])
                start = i
        out.append(word[start:])
        return out

    def merge(self, word: str) -> list[int]:
        """Ids of a long word: the best-scored pair of neighbours first, leftmost on ties."""
        text, after, before = list(word), list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(text):
                found = self.pieces.get(text[i] + text[j])
                if found:
                    heapq.heappush(heap, (-found[1], i, text[i] + text[j]))

        for i in range(len(text) - 1):
            offer(i)
        while heap:
            _, i, piece = heapq.heappop(heap)
            j = after[i]
            if not text[i] or j >= len(text) or text[i] + text[j] != piece:
                continue
            text[i], text[j] = piece, ""
            after[i] = after[j]
            if after[i] < len(text):
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [n for t in text if t for n in self.ids(t)]

    def ids(self, piece: str) -> list[int]:
        """A piece's id, or the ids of a letter outside the vocabulary."""
        if piece in self.pieces:
            return [self.pieces[piece][0]]
        if len(self.bytes) == 256:
            return [self.bytes[b] for b in piece.encode("utf-8", "replace")]
        return [self.unknown]


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    rows = [(p, i, s) for p, (i, s) in vocabulary(path).pieces.items()]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["piece", "id", "score"]), "piece string, id int, score double")


def _bpe_fold(n: Column, edges: Column) -> Column:
    """Borders of the pieces, a string of n + 1 flags.

    Edges of two letters or more come by score; each clears the one border inside it, if it
    has exactly one, while both of its ends stand.
    """
    def step(b: Column, e: Column) -> Column:
        a, z = e["start"], e["stop"]
        inner = F.substring(b, a + 2, z - a - 1)
        ends = (F.substring(b, a + 1, F.lit(1)) == "1") & (F.substring(b, z + 1, F.lit(1)) == "1")
        one = F.length(F.replace(inner, F.lit("0"), F.lit(""))) == 1
        joined = F.concat(F.substring(b, F.lit(1), a + 1), F.repeat(F.lit("0"), z - a - 1), F.substring(b, z + 1, n + 1))
        return F.when(ends & one, joined).otherwise(b)

    ordered = F.array_sort(F.filter(edges, lambda e: e["stop"] - e["start"] > 1))
    return F.aggregate(ordered, F.repeat(F.lit("1"), n + 1), step)


def _viterbi_fold(n: Column, edges: Column) -> Column:
    """Borders of the path with the best sum of scores; a letter without a piece costs a lot."""
    singles = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((i + 1).alias("stop"), i.alias("start"), F.lit(-1e6).alias("score")))
    known = F.transform(edges, lambda e: F.struct(e["stop"].alias("stop"), e["start"].alias("start"), (-e["rank"]).alias("score")))
    ordered = F.array_sort(F.concat(known, singles))
    state = F.array(F.struct(F.lit(0.0).alias("best"), F.array(F.lit(0)).alias("path")))

    def step(paths: Column, e: Column) -> Column:
        # Edges come by their end, so the state holds one path for each place up to there.
        back = F.element_at(paths, e["start"] + 1)
        new = F.struct((back["best"] + e["score"]).alias("best"), F.concat(back["path"], F.array(e["stop"])).alias("path"))
        last = F.element_at(paths, -1)
        better = F.concat(F.slice(paths, F.lit(1), F.size(paths) - 1), F.array(F.when(last["best"] >= new["best"], last).otherwise(new)))
        return F.when(F.size(paths) == e["stop"], F.concat(paths, F.array(new))).otherwise(better)

    path = F.aggregate(ordered, state, step, lambda paths: F.element_at(paths, -1)["path"])
    flags = F.transform(F.sequence(F.lit(0), n), lambda i: F.when(F.array_contains(path, i), "1").otherwise("0"))
    return F.array_join(flags, "")


def encode_words(words: DataFrame, path: str, fold: str = "bpe") -> DataFrame:
    """(word) distinct, plus columns kept along, to (word, ids): lattice, grouping and fold.

    ``words`` has to be partitioned by word (as a grouping leaves it), then nothing is shuffled.
    """
    v = vocabulary(path)
    pieces = piece_table(words.sparkSession, path)
    words.sparkSession.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", GROUPED_WORDS)
    keep = [c for c in words.columns if c != "word"]
    spots = words.select("*", F.explode(F.sequence(F.lit(1), F.greatest(F.length("word"), F.lit(1)))).alias("at"))
    cuts = spots.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(v.longest), F.length("word") - F.col("at") + 1))).alias("len"))
    cuts = cuts.select("word", *keep, F.col("at"), F.col("len"), F.expr("substring(word, at, len)").alias("piece"))
    # Single letters stay even without a piece, so that every word keeps a row.
    lattice = cuts.join(F.broadcast(pieces), "piece", "left").where("id IS NOT NULL OR len = 1")
    edge = F.when(F.col("id").isNotNull(), F.struct((-F.col("score")).alias("rank"), (F.col("at") - 1).alias("start"), (F.col("at") + F.col("len") - 1).alias("stop"), "id"))
    grouped = lattice.groupBy("word").agg(*(F.first(c).alias(c) for c in keep), F.collect_list(edge).alias("edges"))
    n = F.length("word")
    borders = (_bpe_fold if fold == "bpe" else _viterbi_fold)(n, F.col("edges"))
    grouped = grouped.withColumn("borders", borders)
    # The pieces are the edges between two borders without a border inside.
    whole = F.filter("edges", lambda e: (F.substring(F.col("borders"), e["start"] + 1, F.lit(1)) == "1")
                     & (F.substring(F.col("borders"), e["stop"] + 1, F.lit(1)) == "1")
                     & ~F.contains(F.substring(F.col("borders"), e["start"] + 2, e["stop"] - e["start"] - 1), F.lit("1")))
    by_start = F.array_sort(F.transform(whole, lambda e: F.struct(e["start"].alias("start"), e["stop"].alias("stop"), e["id"].alias("id"))))
    bytes_known, first_byte = len(v.bytes) == 256, v.bytes.get(0, 0)

    def spelt(i: Column) -> Column:
        """The piece that starts at letter i, or the letter's bytes if none does and it stands alone."""
        raw = F.hex(F.encode(F.substring(F.col("word"), i + 1, F.lit(1)), "UTF-8"))
        each = F.transform(F.sequence(F.lit(1), F.length(raw), F.lit(2)), lambda k: F.conv(F.substring(raw, k, F.lit(2)), 16, 10).cast("int") + first_byte)
        here = F.transform(F.filter("pieces", lambda p: p["start"] == i), lambda p: p["id"])
        covered = F.exists("pieces", lambda p: (p["start"] < i) & (p["stop"] > i))
        return F.when((F.size(here) > 0) | covered, here).otherwise(each if bytes_known else F.array(F.lit(v.unknown)))

    grouped = grouped.withColumn("pieces", by_start)
    letters = F.aggregate("pieces", F.lit(0), lambda acc, p: acc + p["stop"] - p["start"])
    ids = F.when(letters == n, F.transform("pieces", lambda p: p["id"])).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), n - 1), spelt)))
    return grouped.select("word", *keep, ids.alias("ids"))


def _in_blocks(batches, block_chars: int):
    """(block, doc_ids, texts) of the rows of one task in order, each about a quarter of a block or less.

    A block is a stretch of one input partition, so the words of a task carry few blocks. A task that reads its
    partition again makes the same blocks; should it ever read other rows, words that a block lacks are
    merged on the spot (``look_up``), so blocks decide what moves and never what comes out.
    """
    base, done, ids, texts, held = TaskContext.get().partitionId() << 32, 0, [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(doc_id)
            texts.append(text)
            held += len(text)
            if held * 4 >= block_chars:
                yield base + done // block_chars, ids, texts
                done, ids, texts, held = done + held, [], [], 0
    if ids:
        yield base + done // block_chars, ids, texts


def encode(docs: DataFrame, path: str | None = None, fold: str = "bpe", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per row of *docs*: doc_id, ids array<int>."""
    path = path or piece_path()
    spark = docs.sparkSession
    ship(spark)
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    chars = base.agg(F.sum(F.length("text"))).first()[0] or 0

    def used(batches):
        """The different words of each block in this task."""
        v, mine, at = vocabulary(path), set(), None

        def out():
            parts = {p for w in mine for p in v.parts(w) if len(p) <= LONGEST}
            return pa.record_batch([pa.array([at] * len(parts), pa.int64()), pa.array(list(parts), pa.string())], ["block", "word"])

        for block, _, texts in _in_blocks(batches, block_chars):
            if at is not None and (block != at or len(mine) > HELD_WORDS):
                yield out()
                mine = set()
            at = block
            for text in texts:
                mine.update(v.words(text))
        if at is not None:
            yield out()

    # Few enough words in a partition that their edges are grouped in memory, without a sort.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // PARTITION_CHARS))
    pairs = base.mapInArrow(used, "block bigint, word string").repartition(parts, "word")
    coded = encode_words(pairs.groupBy("word").agg(F.collect_set("block").alias("blocks")), path, fold)
    packed_ids = F.transform("ids", lambda i: F.lpad(F.hex(i), 8, "0"))
    coded = coded.select(F.explode("blocks").alias("block"), "word", F.unhex(F.array_join(packed_ids, "")).alias("ids"))

    def squeeze(batches):
        """Texts of a stretch as one blob; many texts together compress far better than each alone."""
        import zstandard

        coder = zstandard.ZstdCompressor(level=9)
        for block, ids, texts in _in_blocks(batches, block_chars):
            raw = [t.encode("utf-8", "surrogatepass") for t in texts]
            yield pa.record_batch(
                [pa.array([block], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(r) for r in raw]], pa.list_(pa.int64())),
                 pa.array([coder.compress(b"".join(raw))], pa.binary())], ["block", "doc_ids", "sizes", "packed"])

    packed = base.mapInArrow(squeeze, "block bigint, doc_ids array<bigint>, sizes array<bigint>, packed binary")

    def look_up(part: pa.Table, words: pa.Table) -> pa.Table:
        import zstandard

        v, opener = vocabulary(path), zstandard.ZstdDecompressor()
        known = dict(zip(words["word"].to_pylist(), words["ids"].to_pylist(), strict=True))
        rows, found, ends = [], [], [0]
        for doc_ids, sizes, blob in zip(part["doc_ids"].to_pylist(), part["sizes"].to_pylist(), part["packed"], strict=True):
            raw, at = opener.decompress(blob.as_py()), 0
            rows += doc_ids
            for size in sizes:
                text = raw[at : at + size].decode("utf-8", "surrogatepass")
                at += size
                ids = []
                for w in v.words(text):
                    if w in known:
                        ids.append(known[w])
                    else:
                        ids += [known[p] if p in known else np.array(v.merge(p), dtype=">i4").tobytes() for p in v.parts(w)]
                found.append(np.frombuffer(b"".join(ids), dtype=">i4").astype(np.int32))
                ends.append(ends[-1] + len(found[-1]))
        values = pa.array(np.concatenate(found) if found else np.zeros(0, np.int32), pa.int32())
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
        return pa.table([pa.array(rows, pa.int64()), lists], ["doc_id", "ids"])

    return packed.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(look_up, "doc_id bigint, ids array<int>")


def _texts(ids_lists, path: str) -> list[str]:
    v = vocabulary(path)
    if not hasattr(v, "table"):
        byte = {i: bytes([b]) for b, i in v.bytes.items()}
        v.table = [b"" if v.silent[i] else byte.get(i) or n.replace(MARK, " ").encode() for i, n in enumerate(v.names)]
    out = []
    for ids in ids_lists:
        text = b"".join([v.table[i] for i in ids.values.to_numpy()]).decode("utf-8", "replace") if ids.is_valid and len(ids) else ""
        out.append(text[1:] if text.startswith(" ") else text)
    return out


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) to (doc_id, text); the first blank, which encoding adds, goes again.

    The piece table has as many rows as the vocabulary, so tasks hold it; nothing is shuffled.
    """
    path = path or piece_path()
    run = lambda b: pa.record_batch([b.column(0), pa.array(_texts(b.column(1), path), pa.string())], ["doc_id", "text"])
    return map_batches(coded.select("doc_id", "ids"), run, "doc_id bigint, text string")


def with_decoded(coded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids and the decoded text of every row of *coded* (doc_id, ids)."""
    path = path or piece_path()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        lengths = pa.array([len(x) for x in b.column(1)], pa.int64())
        return pa.record_batch([b.column(0), lengths, b.column(1), pa.array(_texts(b.column(1), path), pa.string())], ["doc_id", "n_tokens", "ids", "text"])

    return map_batches(coded.select("doc_id", "ids"), run, "doc_id bigint, n_tokens bigint, ids array<int>, text string")
