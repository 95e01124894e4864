"""Spelling variants: words one edit apart, found with bidirectional FM-indexes.

A word's edit to a near word lies in its first or in its second half (or between them), so the near word
starts with the word's first half or ends with its second. The vocabulary is sorted and cut into blocks
of about ``BLOCK_WORDS`` words, once by the words and once by the words read backwards. A query goes to
those blocks alone that can hold its half: a half that very many words share spans several blocks,
and blocks with many queries are worked in several parts.

In a block the words stand in one text with a delimiter before and after each. The text and its reverse
have suffix arrays and BWTs with rank samples, so an interval of suffix ranks can be extended by a
character at either end, and both intervals stay in step. A search scheme is

* first half: backwards through the half and the delimiter before it, then forwards through the second
  half with one error, then the delimiter; or
* second half: forwards through the half and the delimiter behind it, then backwards through the first half with
  one error, then the delimiter.

All queries of a part advance together, as arrays of intervals.

Edge cases: null and empty texts have no words; a null doc_id is the text ``null`` in the hash; repeated
rows count again; ties of the form go to the smallest word in code-point order; words of any length
are indexed whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, stored

LEAST_LENGTH, LEAST_COUNT, RATIO, NOISE = 6, 5, 5, 199
#: Words of a block, and queries that one task takes to it; both bound memory, not results.
BLOCK_WORDS, PART_QUERIES = 30_000, 60_000
#: Different words a task counts before it hands them on.
COUNTED = 200_000
#: Rank samples, one in this many places of a BWT.
STEP = 64
#: Characters of queries that advance together.
CELLS = 400_000
#: Words whose blocks are named to every task, at most.
MAX_BLOCKS = 200_000
_RUN = re.compile("[a-zA-ZÀ-ÿ]+")


def words_of(doc_id: object, text: bytes | None) -> Counter:
    """Counts of the words of one text (UTF-8): runs in lower case, now and then short of one letter."""
    runs = Counter(_RUN.findall((text or b"").lower().decode("utf-8")))
    seed, out = zlib.crc32(f"{'null' if doc_id is None else doc_id}:".encode()), Counter()
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), seed)
        if h % NOISE == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= LEAST_LENGTH:
            out[run] += n
    return out


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of the words that occur often enough, over all texts."""

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word, n in words_of(doc_id, text).items():
                    held[word] += n
                if len(held) > COUNTED:
                    yield pa.record_batch([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
                    held = Counter()
        yield pa.record_batch([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    ship(docs.sparkSession)
    counts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "word string, n bigint")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


# --- one block -----------------------------------------------------------------


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling; a shorter suffix comes before its continuations."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    n, k = len(text), 1
    while True:
        behind = np.zeros(n, dtype=np.int64)
        behind[: max(n - k, 0)] = rank[k:] + 1
        key = rank * (n + 1) + behind
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        k *= 2


class Ranks:
    """How often characters below c stand in the first i places of a BWT."""

    def __init__(self, bwt: np.ndarray, sigma: int) -> None:
        n = len(bwt)
        blocks = n // STEP + 1
        counts = np.zeros((blocks + 1, sigma + 1), dtype=np.int32)
        np.add.at(counts, (np.arange(n) // STEP + 1, bwt + 1), 1)
        self.sums = np.cumsum(np.cumsum(counts, axis=0, dtype=np.int32), axis=1, dtype=np.int32)
        padded = np.full(blocks * STEP, sigma, dtype=np.uint8 if sigma < 256 else np.int32)
        padded[:n] = bwt
        self.bwt = padded.reshape(blocks, STEP)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(bwt, minlength=sigma))])

    def below(self, c: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(occurrences of characters < c, occurrences of c) in the first i places."""
        b, rest = np.divmod(i, STEP)
        rows = self.bwt[b]
        inside = np.arange(STEP)[None, :] < rest[:, None]
        less = self.sums[b, c] + ((rows < c[:, None]) & inside).sum(axis=1)
        same = self.sums[b, c + 1] - self.sums[b, c] + ((rows == c[:, None]) & inside).sum(axis=1)
        return less, same


class Index:
    """Bidirectional FM-index over words between delimiters (code 0)."""

    def __init__(self, words: list[str]) -> None:
        letters = sorted(set("".join(words)))
        self.codes = {c: i + 1 for i, c in enumerate(letters)}
        self.sigma = len(letters) + 1
        joined = "\0" + "\0".join(words) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
        text = np.searchsorted(np.array([0, *map(ord, letters)], dtype=np.uint32), points)
        order = suffix_array(text)
        self.order = order
        self.word_at = np.cumsum(text == 0) - 1  # the word behind the delimiter at a place
        self.left = Ranks(text[order - 1], self.sigma)  # extends to the left
        turned = text[::-1]
        self.right = Ranks(turned[suffix_array(turned) - 1], self.sigma)  # extends to the right

    def encoded(self, word: str) -> np.ndarray:
        return np.array([self.codes.get(c, self.sigma) for c in word], dtype=np.int64)

    def extend(self, low: np.ndarray, other: np.ndarray, size: np.ndarray, c: np.ndarray, leftwards: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Intervals after one more character; ``low`` is the start in the index of the direction, ``other`` in its twin."""
        ranks = self.left if leftwards else self.right
        known = c < self.sigma
        c = np.where(known, c, 0)
        less_a, same_a = ranks.below(c, low)
        less_b, same_b = ranks.below(c, low + size)
        return ranks.starts[c] + same_a, other + (less_b - less_a), np.where(known, same_b - same_a, 0)

    def following(self, low: np.ndarray, size: np.ndarray, leftwards: bool) -> tuple[np.ndarray, np.ndarray]:
        """(state, character) of every character but the delimiter that can extend each interval."""
        ranks = self.left if leftwards else self.right
        few = size <= self.sigma
        at = np.flatnonzero(few)
        states = np.repeat(at, size[at])
        within = np.arange(len(states)) - np.repeat(np.cumsum(size[at]) - size[at], size[at])
        chars = ranks.bwt.reshape(-1)[low[states] + within].astype(np.int64)
        wide = np.flatnonzero(~few)
        states = np.concatenate([states, np.repeat(wide, self.sigma - 1)])
        chars = np.concatenate([chars, np.tile(np.arange(1, self.sigma), len(wide))])
        both = np.unique(states[chars > 0] * (self.sigma + 1) + chars[chars > 0])
        return both // (self.sigma + 1), both % (self.sigma + 1)


def search(index: Index, queries: list[str], first: bool) -> tuple[np.ndarray, np.ndarray]:
    """(query, word of the block) of words exactly one edit away that share the first (or second) half.

    Queries advance together with others of about their length, ``CELLS`` characters at once.
    """
    sized = sorted(range(len(queries)), key=lambda i: len(queries[i]))
    found, at = [], 0
    while at < len(sized):
        limit = 2 * len(queries[sized[at]])
        end = at
        while end < len(sized) and len(queries[sized[end]]) <= limit and (end == at or (end + 1 - at) * len(queries[sized[end]]) <= CELLS):
            end += 1
        q, w = _search(index, [queries[i] for i in sized[at:end]], first)
        found.append((np.array(sized[at:end], dtype=np.int64)[q], w))
        at = end
    return tuple(np.concatenate([f[k] for f in found]) for k in (0, 1))


def _search(index: Index, queries: list[str], first: bool) -> tuple[np.ndarray, np.ndarray]:
    """As ``search``, all queries at once. A state is (query, place in the other half, intervals); ``spare`` says whether the error is still to come.
    """
    size_of = np.array([len(q) for q in queries])
    cut = size_of // 2
    width = int(size_of.max())
    exact = np.full((len(queries), width + 1), -1, dtype=np.int64)
    loose = np.full((len(queries), width + 1), -1, dtype=np.int64)
    for i, q in enumerate(queries):
        codes, h = index.encoded(q), len(q) // 2
        one, two = (codes[:h][::-1], codes[h:]) if first else (codes[h:], codes[:h][::-1])
        exact[i, : len(one)], exact[i, len(one)] = one, 0
        loose[i, : len(two)], loose[i, len(two)] = two, 0
    # The exact half and its delimiter, away from the middle.
    who = np.arange(len(queries))
    n = len(index.order)
    near, far, size = np.zeros(len(who), np.int64), np.zeros(len(who), np.int64), np.full(len(who), n)
    for j in range(width + 1):
        go = exact[who, j] >= 0
        if not go.any():
            break
        a, b, s = index.extend(near[go], far[go], size[go], exact[who[go], j], leftwards=first)
        near[go], far[go], size[go] = a, b, s
        keep = size > 0
        who, near, far, size = who[keep], near[keep], far[keep], size[keep]
    # The other way, with one error.
    low, other = far, near
    hits_q, hits_w = [], []
    late = (np.zeros(0, np.int64),) * 4  # states whose error is spent: (query, interval, twin, size)
    late_at = np.zeros(0, np.int64)
    for j in range(width + 1):
        want = loose[who, j]
        alive = want >= 0
        who, low, other, size, want = who[alive], low[alive], other[alive], size[alive], want[alive]
        # Spend the error here: another character for this one, one more before it, or none for it.
        state, c = index.following(low, size, leftwards=not first)
        a, b, s = index.extend(low[state], other[state], size[state], c, leftwards=not first)
        swap = (c != want[state]) & (want[state] > 0) & (s > 0)
        more = (c != want[state]) & (s > 0)  # more of the same letter is one more behind it
        skip = want > 0
        # A step ahead: places after the swapped or skipped character; the same place after one more.
        fresh_q = np.concatenate([who[state[swap]], who[skip], who[state[more]]])
        fresh_at = np.concatenate([np.full(swap.sum(), j + 1), np.full(skip.sum(), j + 1), np.full(more.sum(), j)])
        fresh = [np.concatenate(p) for p in ((a[swap], low[skip], a[more]), (b[swap], other[skip], b[more]), (s[swap], size[skip], s[more]))]
        late = tuple(np.concatenate(p) for p in zip(late, (fresh_q, *fresh), strict=True))
        late_at = np.concatenate([late_at, fresh_at])
        # Spent states at this place read its character.
        now = late_at == j
        if now.any():
            q, a, b, s = (p[now] for p in late)
            _, once = np.unique((q * (n + 1) + a) * (n + 1) + s, return_index=True)  # errors at different places may read the same
            q, a, b, s = q[once], a[once], b[once], s[once]
            c = loose[q, j]
            a, b, s = index.extend(a, b, s, c, leftwards=not first)
            done = (c == 0) & (s > 0)
            if done.any():
                # At the end the interval is "delimiter, word, delimiter"; its place in the forward index names the word.
                forward = b[done] if first else a[done]
                hits_q.append(q[done])
                hits_w.append(index.word_at[index.order[forward]])
            go = (c > 0) & (s > 0)
            late = tuple(np.concatenate([p[~now], f[go]]) for p, f in zip(late, (q, a, b, s), strict=True))
            late_at = np.concatenate([late_at[~now], np.full(go.sum(), j + 1)])
        # States without an error go on.
        a, b, s = index.extend(low, other, size, want, leftwards=not first)
        go = (want > 0) & (s > 0)
        who, low, other, size = who[go], a[go], b[go], s[go]
        if not len(who) and not len(late_at):
            break
    if not hits_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.unique(np.concatenate(hits_q) * (n + 1) + np.concatenate(hits_w))
    return both // (n + 1), both % (n + 1)


# --- all blocks ------------------------------------------------------------------


def _bounds(blocks: DataFrame) -> list[tuple[str, str, int]]:
    """(smallest, largest, block) in order; as many rows as blocks."""
    rows = blocks.groupBy("block").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).limit(MAX_BLOCKS + 1).collect()
    if len(rows) > MAX_BLOCKS:
        raise ValueError("too many blocks of words to name to every task; raise BLOCK_WORDS")
    return sorted((r["lo"], r["hi"], r["block"]) for r in rows)


def _near_by_half(words: DataFrame, count: int, first: bool) -> DataFrame:
    """(word, other) pairs one edit apart that share the word's first (or second) half."""
    key = F.col("word") if first else F.reverse("word")
    parts = max(1, -(-count // BLOCK_WORDS))
    ranged = words.select("word", key.alias("key")).repartitionByRange(parts, "key")
    blocks = stored(ranged.withColumn("block", F.spark_partition_id()), "spelling_blocks")
    bounds = _bounds(blocks)
    lows, highs = [b[0] for b in bounds], [b[1] for b in bounds]

    def route(batches):
        for batch in batches:
            out_q, out_b = [], []
            for q in batch.column(0).to_pylist():
                half = q[: len(q) // 2] if first else q[len(q) // 2 :][::-1]
                at = bisect.bisect_left(highs, half)
                while at < len(lows) and (lows[at] <= half or lows[at].startswith(half)):
                    out_q.append(q)
                    out_b.append(bounds[at][2])
                    at += 1
            yield pa.record_batch([pa.array(out_b, pa.int32()), pa.array(out_q, pa.string())], ["block", "query"])

    routed = words.select("word").mapInArrow(route, "block int, query string")
    busy = {r["block"]: -(-r["n"] // PART_QUERIES) for r in routed.groupBy("block").agg(F.count("*").alias("n")).collect() if r["n"] > PART_QUERIES}
    if busy:
        ways = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in busy.items() for x in kv]), F.col("block")), F.lit(1))
    else:
        ways = F.lit(1)
    asked = routed.withColumn("part", F.pmod(F.xxhash64("query"), ways).cast("int"))
    held = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), ways - 1)))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        block, queries = left.column("word").to_pylist(), right.column("query").to_pylist()
        q, w = search(Index(block), queries, first) if block and queries else ([], [])
        named = [pa.array([queries[i] for i in q], pa.string()), pa.array([block[i] for i in w], pa.string())]
        return pa.table(named, names=["word", "other"])

    return held.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInArrow(meet, "word string, other string")


def near_words(words: DataFrame) -> DataFrame:
    """Every ordered pair (word, other) of ``words`` (word, n) exactly one edit apart."""
    ship(words.sparkSession)
    count = words.count()
    return _near_by_half(words, count, True).union(_near_by_half(words, count, False)).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms followed to the last by doubling; a chain's counts grow fivefold a step, so few rounds do."""
    links = stored(forms.select("word", F.col("form").alias("root")), "spelling_roots")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        jumped = links.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved"))
        jumped = stored(jumped, "spelling_roots")
        links = jumped.select("word", "root")
        if jumped.where("_moved").isEmpty():
            return links


def spelling_variants(docs: DataFrame) -> DataFrame:
    """One row per word: its near words counted, its form and the root of its forms."""
    words = stored(vocabulary(docs), "spelling_words")
    near = near_words(words)
    sized = near.join(words.select(F.col("word").alias("other"), F.col("n").alias("m")), "other")
    best = sized.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("k"), F.col("other"))).alias("pick"))
    found = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(-F.col("pick.k") >= RATIO * F.col("n"), F.struct(F.col("pick.other").alias("form"), (-F.col("pick.k")).alias("form_n"))).alias("f"))
    found = stored(found.select("word", "n", "n_near", "f.form", "f.form_n"), "spelling_forms")
    roots = _roots(found.where("form IS NOT NULL"))
    out = found.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
