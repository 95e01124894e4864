"""N-gram Jaccard self-join by universe partition and pigeonhole.

A document is the set of its word n-grams. Two sets link when their Jaccard similarity
reaches num/den, so for sets in a band of sizes [lo, hi] (the size of the smaller) their
symmetric difference has at most H = hi * (den - num) // num elements. The universe of
n-grams is cut by hash into segments: a linked pair cannot differ in all of them.

* An exact segment matches when it is the same in both sets; missing it costs one difference.
* A one-deletion segment also matches when one side has one more element, found through keys
  of the segment with each element left out; missing it costs two differences.

With m0 + 2 * m1 >= H + 1 segments some segment matches. Which mix to index is decided for each
band by estimated cost from the band's document count (``allocate``). Segments that are empty in a
document are not indexed as long as the pigeonhole count still holds without them; a
document for which it does not hold indexes them too, so no link is lost.

Keys meet in one shuffle, and keys that the same documents share become one. Each document first gets one
candidate, the smallest document that it meets, after an exact filter: 1,024 parity bits of the set bound the
symmetric difference from below; they join where pairs are formed. Candidates are verified on the sets themselves and linked into components. While keys
hold many pairs across components, each document outside its key's largest component is verified against
four members at most, others every turn. Then all pairs that meet in some key and still lie in different components are
verified too. A group of thousands of near copies costs a few verified pairs a document, not all pairs.

Edge cases: null and empty texts have no n-grams and link with nothing; a text with fewer words than
n is one n-gram; sets that are equal are one class, found by grouping; repeated rows and null ids
are allowed (a component's id is its smallest non-null doc_id); extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import anti_by_id, hot_join, map_batches, only_cache, stored
from .components import components

#: 1,024 bits: fewer fill up with the differences of longer texts, and then rule out nothing.
PARITY_LONGS = 16
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Words whose hash a worker remembers.
CACHE_WORDS = 200_000
_WORDS: dict[bytes, int] = {}
#: Turns in which a row meets ``HUBS`` of the largest component at most, and pairs a row from which such a turn pays.
ROUNDS, HUBS, PAIRS_A_ROW = 3, 4, 8


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of *text*, A-Z lower-cased."""
    only_cache("ngram_join", _WORDS)
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    try:
        h = np.array([_WORDS[w] for w in words], dtype=np.uint64)
    except KeyError:
        if len(_WORDS) > CACHE_WORDS:
            _WORDS.clear()
        for w in words:
            if w not in _WORDS:
                _WORDS[w] = xxhash.xxh64_intdigest(w)
        h = np.array([_WORDS[w] for w in words], dtype=np.uint64)
    n = min(n, len(words))
    with np.errstate(over="ignore"):
        acc = np.full(len(h) - n + 1, n, dtype=np.uint64)
        for i in range(n):
            acc = _mix((acc + _M1) ^ h[i : len(h) - n + 1 + i])
    return np.unique(acc)


def band_of(size: int, num: int, den: int, _cache: dict = {}) -> tuple[int, int, int]:  # noqa: B006
    """(index, lo, hi) of the band that holds *size*; bands grow by den/num."""
    bands = _cache.setdefault((num, den), [])
    while not bands or bands[-1][2] < size:
        lo = bands[-1][2] + 1 if bands else 1
        bands.append((len(bands), lo, max(lo, lo * den // num)))
    left, right = 0, len(bands) - 1
    while left < right:
        mid = (left + right) // 2
        left, right = (left, mid) if bands[mid][2] >= size else (mid + 1, right)
    return bands[left]


def allocate(lo: int, hi: int, num: int, den: int, docs: int) -> tuple[int, int, int]:
    """(H, m0, m1) for a band: the mix of segments with the least estimated cost.

    A document costs one key for each exact segment and one for each one-deletion segment and each
    element in it. Each exact segment that holds a single element is an index entry on that
    element alone, which unrelated documents share; that noise grows with the number of documents.
    """
    most = hi * (den - num) // num
    size, best = (lo + hi) / 2, None
    for share in (0.0, 0.25, 0.5, 0.75, 1.0):
        units = most + 1
        for _ in range(4):  # spare units for segments that will be empty
            m1 = int(units * share) // 2
            m0 = units - 2 * m1
            lam = lo / units
            empty = m0 * math.exp(-lam) + 2 * m1 * math.exp(-2 * lam) * (1 + 2 * lam)
            units = most + 1 + (math.ceil(empty + 2 * math.sqrt(empty)) if most else 0)
        m1 = int(units * share) // 2
        m0, lam = units - 2 * m1, size / units
        keys = m0 + m1 * (1 + 2 * lam)
        noise = m0 * lam * math.exp(-lam) + m1 * 4 * lam * lam * math.exp(-2 * lam)
        cost = keys + noise * math.log2(1 + docs)
        if best is None or cost < best[0]:
            best = (cost, m0, m1)
    return most, best[1], best[2]


def keys_of(s: np.ndarray, band: int, most: int, m0: int, m1: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, kinds) of one set in one band's segments; kind 1 marks one-deletion keys."""
    with np.errstate(over="ignore"):
        slot = ((s >> np.uint64(8)) % np.uint64(m0 + 2 * m1)).astype(np.int64)
        seg = np.where(slot < m0, slot, m0 + (slot - m0) // 2)
        order = np.argsort(seg, kind="stable")
        seg, val = seg[order], _mix(s[order] + _M1)
        count = np.bincount(seg, minlength=m0 + m1)
        starts = np.cumsum(count) - count
        total = np.zeros(m0 + m1, dtype=np.uint64)
        full = count > 0
        total[full] = np.add.reduceat(val, starts[full])
        place = _mix(np.arange(m0 + m1, dtype=np.uint64) * _M3 + np.uint64(band + 1) * _M1)
        # What the pigeonhole count loses if empty segments are not indexed.
        spared = int((~full[:m0]).sum()) + 2 * int((count[m0:] <= 1).sum())
        sparse = m0 + 2 * m1 - spared < most + 1
        named = np.ones(m0 + m1, dtype=bool) if sparse else full
        keys, kinds = [_mix(total[named] ^ place[named])], [np.zeros(int(named.sum()), dtype=np.int8)]
        if m1:
            less = (seg >= m0) & ((count[seg] > 1) | sparse)
            keys.append(_mix((total[seg[less]] - val[less]) ^ place[seg[less]]))
            kinds.append(np.ones(int(less.sum()), dtype=np.int8))
    return np.concatenate(keys).view(np.int64), np.concatenate(kinds)


def _describe(n: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        size, a, b, bits = [], [], [], []
        for text in batch.column(1).to_pylist():
            s = shingles(text, n)
            with np.errstate(over="ignore"):
                size.append(len(s))
                a.append(_mix(s).sum(dtype=np.uint64))
                b.append(_mix(s * _M3 + _M1).sum(dtype=np.uint64))
            parity = np.bincount((s & np.uint64(64 * PARITY_LONGS - 1)).astype(np.int64), minlength=64 * PARITY_LONGS) & 1
            bits.append(np.packbits(parity.astype(np.uint8)))
        longs = np.frombuffer(b"".join(x.tobytes() for x in bits), dtype="<i8").reshape(-1, PARITY_LONGS)
        return pa.record_batch(
            [batch.column(0), pa.array(size, pa.int64()), pa.array(np.array(a, dtype=np.uint64).view(np.int64)), pa.array(np.array(b, dtype=np.uint64).view(np.int64)),
             pa.array(list(longs), pa.list_(pa.int64()))],
            ["doc_id", "n_shingles", "h1", "h2", "parity"],
        )

    return run


def _may_link(a: str, b: str, num: int, den: int):
    """Exact filter: sizes and parity bits allow the similarity."""
    na, nb = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    differ = sum((F.bit_count(F.col(f"{a}.parity")[i].bitwiseXOR(F.col(f"{b}.parity")[i])) for i in range(PARITY_LONGS)), F.lit(0))
    # |x ^ y| <= (den - num) / (den + num) * (|x| + |y|)
    return (na * den >= nb * num) & (nb * den >= na * num) & (differ * (den + num) <= (na + nb) * (den - num))


def _verify(pairs: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Those of the stored pairs (u, v) whose sets reach the similarity."""
    ids = stored(pairs.select(F.explode(F.array("u", "v")).alias("cid")).distinct(), "pair_ids")
    some = anti_by_id(texts, ids, "cid", ids.count(), "left_semi")
    left, right = some.select(F.col("cid").alias("u"), F.col("text").alias("tu")), some.select(F.col("cid").alias("v"), F.col("text").alias("tv"))
    both = pairs.join(left, "u").join(right, "v").select("u", "v", "tu", "tv")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known: dict[int, np.ndarray] = {}
        u, v = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        keep = []
        for i in range(len(u)):
            if u[i] not in known:
                if len(known) > 2000:
                    known.clear()
                known[u[i]] = shingles(batch.column(2)[i].as_py(), n)
            a, b = known[u[i]], shingles(batch.column(3)[i].as_py(), n)
            same = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(den * same >= num * (len(a) + len(b) - same))
        mask = pa.array(keep, pa.bool_())
        return pa.record_batch([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["u", "v"])

    return stored(map_batches(both, run, "u bigint, v bigint"), "verified")


def _open(rows: DataFrame) -> DataFrame:
    """Rows of the keys in which different components meet, with ``top``, the label of most of the key's rows."""
    over = lambda f: F.expr(f"{f}(label) OVER (PARTITION BY key)")
    return stored(rows.withColumns({"lo": over("min"), "hi": over("max")}).where("lo <> hi").drop("lo", "hi").withColumn("top", over("mode")), "open")


def _with_hubs(spread: DataFrame, size: DataFrame, turn: int, num: int, den: int) -> DataFrame:
    """At most ``HUBS`` pairs (u, v) for a document outside its keys' largest components: with members of those, others each turn."""
    hubs = spread.where("kind = 0 AND label = top").groupBy("key").agg(F.min_by("cid", F.xxhash64("cid", F.lit(turn))).alias("v"))
    met = spread.where("label <> top").select("key", F.col("cid").alias("u")).join(hubs, "key").select("u", "v").distinct()
    few = _filtered(met, size, num, den).groupBy("u").agg(F.slice(F.array_sort(F.collect_set("v")), 1, HUBS).alias("vs")).select("u", F.explode("vs").alias("v"))
    return few.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _labelled(df: DataFrame, roots: DataFrame, total: int) -> DataFrame:
    """*df* with ``label``: the root of its cid, or the cid itself."""
    sized = roots.select(F.col("node").alias("cid"), F.col("root").alias("_root"))
    return df.join(sized, "cid", "left").withColumn("label", F.coalesce("_root", "cid")).drop("_root")


def ngram_components(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One row per row of *docs*: doc_id, n_shingles, component_id, verified_links (of its class)."""
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    prints = stored(map_batches(base, _describe(n), "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, parity array<bigint>"), "prints")
    total, distinct, nulls = prints.agg(F.count("*"), F.count_distinct("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    classes = prints.where("n_shingles > 0").groupBy("n_shingles", "h1", "h2", "parity").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    # A class is named by its smallest doc_id where those are unique; else by a number of its own.
    own_ids = total == distinct and nulls == 0
    classes = stored(classes.withColumn("cid", F.col("rep") if own_ids else F.monotonically_increasing_id()), "classes")
    counts = {}
    for size, c in classes.groupBy("n_shingles").count().collect():  # as many rows as there are different sizes of a set
        counts[band_of(size, num, den)] = counts.get(band_of(size, num, den), 0) + c
    plan = {b[0]: (b[1], b[2], *allocate(b[1], b[2], num, den, counts.get(b, 0))) for b in map(lambda s: band_of(s, num, den), _band_sizes(counts, num, den))}
    if own_ids:
        gone = stored(prints.where("n_shingles = 0").select("doc_id").unionByName(
            prints.select("doc_id", "n_shingles", "h1", "h2").join(classes.where("copies > 1").select("n_shingles", "h1", "h2", "rep"), ["n_shingles", "h1", "h2"]).where("doc_id <> rep").select("doc_id")), "gone")
        texts = anti_by_id(base, gone, "doc_id", gone.count()).select(F.col("doc_id").alias("cid"), "text")
    else:
        texts = _texts_by_class(base, classes, n)

    def emit(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids, keys, kinds = [], [], []
        for cid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            s = shingles(text, n)
            if not len(s):
                continue
            b = band_of(len(s), num, den)[0]
            least = -(-len(s) * num // den)
            while b >= 0 and plan[b][1] >= least:
                if plan[b][2]:  # at no difference at all the sets are one class already
                    k, kind = keys_of(s, b, *plan[b][2:])
                    keys.append(k), kinds.append(kind), ids.append(np.full(len(k), cid, dtype=np.int64))
                b -= 1
        if not keys:
            return None
        return pa.record_batch([pa.array(np.concatenate(keys)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(kinds))], ["key", "cid", "kind"])

    keyed = map_batches(texts, emit, "key bigint, cid bigint, kind tinyint")
    met = keyed.withColumns({
        "center": F.expr("min(CASE WHEN kind = 0 THEN cid END) OVER (PARTITION BY key)"),
        "far": F.expr("max(cid) OVER (PARTITION BY key)"),
        "near": F.expr("min(cid) OVER (PARTITION BY key)"),
        "members": F.expr("bit_xor(xxhash64(cid, kind)) OVER (PARTITION BY key)"),
    }).where("center IS NOT NULL AND far <> near").groupBy(F.col("members").alias("key"), "cid", "kind", "center").agg(F.count("*").alias("keys"))
    met = stored(met, "met")  # a key for each different group, and how many it stands for; groups of equal hash would only meet more
    size = classes.select("cid", "n_shingles", "parity")

    stars = met.where("cid <> center").select(F.greatest("cid", "center").alias("u"), F.least("cid", "center").alias("v")).distinct()
    first = stored(_filtered(stored(stars, "stars"), size, num, den).groupBy("u").agg(F.min("v").alias("v")), "pairs")
    links = _verify(first, texts, n, num, den)
    roots = stored(components(links), "roots")

    spread = _open(_labelled(met.select("key", "cid", "kind", "keys"), roots, total))
    tried, every, share = first, links, 1.0
    for turn in range(ROUNDS):
        size_of = spread.groupBy("key").agg(F.sum("keys").alias("n"), F.count_if(F.col("label") != F.col("top")).alias("m"))
        rows, pairs = size_of.agg(F.sum("n"), F.sum(F.col("n") * F.col("m"))).first()
        if share < 0.25 or (pairs or 0) <= PAIRS_A_ROW * (rows or 0):
            break
        some = stored(_with_hubs(spread, size, turn, num, den).join(tried, ["u", "v"], "left_anti"), "some")
        more = _verify(some, texts, n, num, den)
        share, tried, every = more.count() / max(1, some.count()), tried.unionByName(some), every.unionByName(more)
        spread = _open(_labelled(spread.drop("label", "top"), stored(components(every), "roots"), total))
    sized = spread.join(size, "cid")
    a, b = sized.where("label <> top").alias("a"), sized.alias("b")
    # Of two rows with different labels one at least has not the label of most; if both have not, the larger cid comes first.
    cross = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.label") != F.col("b.label")) & ((F.col("b.label") == F.col("b.top")) | (F.col("a.cid") > F.col("b.cid")))
                   & ((F.col("a.kind") == 0) | (F.col("b.kind") == 0)) & _may_link("a", "b", num, den))
    cross = cross.select(F.greatest("a.cid", "b.cid").alias("u"), F.least("a.cid", "b.cid").alias("v")).distinct()
    cross = stored(cross.join(tried, ["u", "v"], "left_anti"), "pairs")
    every = every.unionByName(_verify(cross, texts, n, num, den))
    roots = stored(components(every), "roots")
    degree = every.select(F.explode(F.array("u", "v")).alias("cid")).groupBy("cid").agg(F.count("*").alias("verified_links"))
    named = _labelled(classes, roots, total)
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"), F.count("*").alias("_n"))
    named = hot_join(named, least, ["label"], "_n", max(1, total)).join(degree, "cid", "left")
    named = named.select("n_shingles", "h1", "h2", "copies", "component_id", F.coalesce("verified_links", F.lit(0).cast("bigint")).alias("verified_links"))
    found = hot_join(prints.where("n_shingles > 0").select("doc_id", "n_shingles", "h1", "h2"), named, ["n_shingles", "h1", "h2"], "copies", total)
    none = prints.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("bigint").alias("verified_links"))
    return found.select("doc_id", "n_shingles", "component_id", "verified_links").unionByName(none)


def _band_sizes(counts: dict, num: int, den: int) -> list[int]:
    """One size for every band from 1 up to the largest that occurs."""
    if not counts:
        return []
    sizes, top = [1], max(b[2] for b in counts)
    while band_of(sizes[-1], num, den)[2] < top:
        sizes.append(band_of(sizes[-1], num, den)[2] + 1)
    return sizes


def _filtered(pairs: DataFrame, size: DataFrame, num: int, den: int) -> DataFrame:
    a = size.select(F.col("cid").alias("u"), F.struct("n_shingles", "parity").alias("a"))
    b = size.select(F.col("cid").alias("v"), F.struct("n_shingles", "parity").alias("b"))
    return pairs.join(a, "u").join(b, "v").where(_may_link("a", "b", num, den)).select("u", "v")


def _texts_by_class(base: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """(cid, text) where doc_ids repeat or are null: rows meet their class by the set's hashes."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        d = _describe(n)(pa.record_batch([batch.column(0), batch.column(1)], ["doc_id", "text"]))
        return pa.record_batch([batch.column(1), d.column(1), d.column(2), d.column(3)], ["text", "n_shingles", "h1", "h2"])

    rows = map_batches(base, run, "text string, n_shingles bigint, h1 bigint, h2 bigint")
    one = rows.groupBy("n_shingles", "h1", "h2").agg(F.max("text").alias("text"))
    return stored(one.join(classes.select("n_shingles", "h1", "h2", "cid"), ["n_shingles", "h1", "h2"]).select("cid", "text"), "texts")


def drop_near_copies(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """*docs* with one document of each component, the one with the smallest doc_id, all columns kept.

    Rows without a doc_id stay, since nothing tells them apart; so do rows that repeat the doc_id that stays.
    """
    found = ngram_components(docs, n, num, den)
    gone = stored(found.where("doc_id <> component_id").select("doc_id"), "near")
    return anti_by_id(docs, gone.distinct(), "doc_id", gone.count())
