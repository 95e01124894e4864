"""Line dedup by a template tree of fixed depth, in DataFrame functions only.

A line goes down a tree: first by its number of tokens (parts between white space), then by its first ``DEPTH`` tokens, where a token
with a digit counts as a variable field. All lines that share this path are a leaf. In a leaf, lines
that are equal but for fields with digits have one template. Of the other lines of a leaf, three from different texts
have one template if all three have the same token in at least seven of ten places; the other places are variable fields.
That depends on these lines only, never on how many others the leaf holds. A template that occurs in ``MIN_TEXTS``
different texts or more is dropped from all of them. Copies of a whole text count once, so that a document's copies do not erase it.

Everything that is grouped is a hash of eight bytes; lines themselves travel only where a leaf is open. A
very common line is counted map-side first and joined by broadcast or by a splittable join.

Edge cases: a null text stays null and an empty one empty; lines of fewer than ``MIN_TOKENS`` tokens and blank
lines stay; repeated rows repeat; a line of any length is one line; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_IDS, hot_join, stored

DEPTH = 3
MIN_TOKENS = 4
MIN_TEXTS = 3
#: Share of constants that a template has, in tenths.
CONSTANT_TENTHS = 7
#: Lines that are compared with each other at once, and lines of a bucket up to which those without a template meet all others:
#: splitting puts a line into a dozen buckets and more, each of which moves, so it pays in larger ones only.
CHUNK, FULL = 32, 2_048
#: Lines of one task that compares them.
TASK_LINES = 1_000
#: What white space other than single blanks a line may hold.
_ODD = ("\t", "\r", "\x0b", "\f", "  ")
_FIELD = r"(?<!\S)[^\s0-9]*+[0-9]\S*"


def _spaced(line: Column) -> Column:
    """A line with single blanks between its tokens. Cheap where it is so already: Spark may evaluate this more than once."""
    odd = reduce(lambda a, b: a | b, (F.contains(line, F.lit(c)) for c in _ODD))
    return F.trim(F.when(odd, F.regexp_replace(line, r"\s+", " ")).otherwise(line))


def _masked(line: Column) -> Column:
    """A spaced line; tokens with a digit are fields."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, _FIELD, "<*>")).otherwise(line)


def _places(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), at and line of every line."""
    return docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("at", "line"))


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, th, at, leaf, line (hash of the masked line) of lines long enough."""
    out = _places(docs).withColumn("line", _spaced(F.col("line"))).withColumn("size", F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1)
    out = out.where(F.col("size") >= MIN_TOKENS).withColumn("line", _masked(F.col("line")))
    return out.select("doc_id", "th", "at", F.xxhash64("size", F.substring_index("line", " ", DEPTH)).alias("leaf"), F.xxhash64("line").alias("line"))


def _fields(tokens: Column | str) -> Column:
    """Most variable fields that a template of so many tokens may have."""
    return F.floor(F.size(tokens) * (10 - CONSTANT_TENTHS) / 10).cast("int")


def _recurring(rows: DataFrame, key: str) -> DataFrame:
    """Keys with their number of different texts, of those that reach MIN_TEXTS."""
    return rows.groupBy(key, "th").agg(F.lit(1).alias("one")).groupBy(key).agg(F.count("*").alias("texts")).where(F.col("texts") >= MIN_TEXTS)


def _few(df: DataFrame) -> DataFrame:
    """A hint to broadcast a stored table of keys, if a count shows that it is within the bound."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_IDS else df


def _extended(state: DataFrame, rows: DataFrame) -> DataFrame:
    """Every (line, bucket) once for each part of its free places, with that part's tokens added to the bucket.

    There is one part more than a template may have fields, so the lines of a template share the
    bucket of at least one part.
    """
    parts = _fields("t") + 1
    cut = lambda j: F.floor(j * F.size("free") / parts).cast("int")
    part = lambda j: F.slice("free", cut(j) + 1, cut(j + 1) - cut(j))
    made = state.select("line", "bucket", "free").join(rows, "line").withColumn("j", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("part", part(F.col("j")))
    tokens = F.transform("part", lambda i: F.get("t", i))
    return made.select("line", F.xxhash64("bucket", "part", tokens).alias("bucket"), F.array_except("free", "part").alias("free"))


def _compared(held: DataFrame, rows: DataFrame, parts: int, size: int, known: DataFrame | None = None) -> DataFrame:
    """Lines with a template within their chunk of a bucket: three texts whose lines agree in enough places.

    With *known* lines, only templates that hold another line are looked for.
    """
    chunk = F.pmod(F.col("line"), F.ceil(F.col("n") / size)).alias("chunk")
    both = held.select("line", "bucket", chunk).join(rows.select("line", "ths", "t"), "line").repartition(parts, "bucket", "chunk")
    others = both if known is None else both.join(_few(known), "line", "left_anti")
    x, y, z = others.alias("x"), both.alias("y"), both.alias("z")
    once = F.col("x.line") < F.col("y.line") if known is None else F.col("x.line") != F.col("y.line")
    together = lambda a, b: (F.col(f"{a}.bucket") == F.col(f"{b}.bucket")) & (F.col(f"{a}.chunk") == F.col(f"{b}.chunk"))
    least = F.size("x.t") - _fields("x.t")
    # A token's hash holds its place, so equal places are common elements.
    same = F.array_intersect("x.t", "y.t")
    pairs = x.join(y, together("x", "y") & once & (F.size(same) >= least))
    pairs = pairs.select("x.bucket", "x.chunk", F.col("x.line").alias("line"), F.col("y.line").alias("other"), same.alias("same"), F.array_union("x.ths", "y.ths").alias("ths"), least.alias("least"))
    # The third line may be the second again: two lines may be of three texts.
    agrees = (F.col("z.line") != F.col("p.line")) & (F.size(F.array_intersect("p.same", "z.t")) >= F.col("p.least"))
    found = pairs.alias("p").join(z, together("p", "z") & agrees & (F.size(F.array_union("p.ths", "z.ths")) >= MIN_TEXTS), "left_semi")
    return found.select(F.explode(F.array("line", "other")).alias("line"))


def _templates(rows: DataFrame) -> DataFrame:
    """Lines that agree with lines of two other texts of their leaf in ``CONSTANT_TENTHS`` of all places, the same for all three.

    A bucket starts as a leaf. Buckets are compared by chunks of ``CHUNK`` lines first, which finds the lines of frequent templates.
    In those of at most ``FULL`` lines, lines left are then compared with all others; larger ones are split by further tokens, with as
    many ways as it takes to lose no template, until they are small enough or share enough places.
    """
    state = rows.select("line", F.col("leaf").alias("bucket"), F.sequence(F.lit(DEPTH), F.size("t") - 1).alias("free"))
    found = rows.select("line").limit(0)
    # By rows: comparing them costs far more than their bytes tell.
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // TASK_LINES))
    while True:
        size = state.join(rows.select("line", F.size("ths").alias("k"), _fields("t").alias("m")), "line")
        size = stored(size, "sized")
        # Not yet different texts, so a bound from above.
        n = stored(size.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("k").alias("k")).where(F.col("k") >= MIN_TEXTS).select("bucket", "n", F.col("n").alias("many")), "sizes")
        held = stored(hot_join(size.drop("k"), n, ["bucket"], "many", max(1, size.count())), "held")
        whole = held.where(F.size("free") <= F.col("m"))
        texts = whole.join(rows.select("line", F.explode("ths").alias("th")), "line")
        found = found.union(whole.join(_few(stored(_recurring(texts, "bucket").select("bucket"), "whole")), "bucket", "left_semi").select("line"))
        rest = held.where(F.size("free") > F.col("m"))
        # Each line in its largest bucket; then the buckets of lines not found so.
        first = rest.groupBy("line").agg(F.max_by(F.struct("bucket", "n"), F.struct("n", "bucket")).alias("b")).select("line", "b.*")
        found = stored(found.union(_compared(first, rows, parts, CHUNK)).distinct(), "found")
        left = stored(rest.join(found, "line", "left_anti").select("bucket").distinct(), "left")
        again = rest.join(left, "bucket", "left_semi")
        found = stored(found.union(_compared(again.where(F.col("n") <= FULL), rows, parts, FULL, found)).distinct(), "found")
        large = stored(again.where(F.col("n") > FULL).select("line", "bucket", "free"), "large")
        if large.isEmpty():
            return found
        state = stored(_extended(large, rows), "extended")
        wanted = state.join(found, "line", "left_anti").select("bucket").distinct()
        state = stored(state.join(wanted, "bucket", "left_semi"), "state")


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, th, at) of every line that a recurring template covers."""
    lines = _lines(docs)
    keys = stored(lines, "line_keys")
    plain = stored(_recurring(keys, "line").select("line"), "plain")
    # Leaves that still have lines of enough texts after those.
    left = keys.join(_few(plain), "line", "left_anti")
    open_leaves = stored(_recurring(left, "leaf").select("leaf"), "leaves")
    # One place for a line, and the two texts at most that hold it; the hash stands for the line from here on.
    spot = F.min(F.struct("th", "at")).alias("spot")
    some = left.join(_few(open_leaves), "leaf", "left_semi").groupBy("line").agg(F.first("leaf").alias("leaf"), F.collect_set("th").alias("ths"), spot)
    some = stored(some, "open_keys").select("line", "leaf", "ths", "spot.*")
    # Tokens are read again at those places only; copies of a text have the same ones.
    texts = some.select("th").distinct()
    read = docs.join(_few(stored(texts, "open_texts")), F.xxhash64("text") == F.col("th"), "left_semi")
    read = _places(read.select("doc_id", "text")).join(some.select("th", "at", F.col("line").alias("key")), ["th", "at"])
    read = read.groupBy("key").agg(F.first("line").alias("line")).select(F.col("key").alias("line"), F.split(_masked(_spaced(F.col("line"))), " ").alias("t"))
    rows = some.drop("th", "at").join(read, "line")
    rows = stored(rows.withColumn("t", F.transform("t", lambda t, place: F.xxhash64(t, place))), "open_lines")
    general = _templates(rows)
    drop = stored(plain.union(general).distinct(), "drop")
    return keys.join(_few(drop), "line", "left_semi").select("doc_id", "th", "at")


def line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, text without the lines of recurring templates, n_lines and n_dropped of every row."""
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    places = dropped_lines(base).groupBy("doc_id", "th").agg(F.collect_set("at").alias("places"))
    places = stored(places.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "places"), "places")
    n_rows, n_places = places.agg(F.count("*"), F.coalesce(F.sum(F.size("places")), F.lit(0))).first()
    # About four bytes a place and sixteen a row.
    side = F.broadcast(places) if n_rows + n_places // 4 <= MAX_BROADCAST_IDS else places
    found = base.withColumn("_h", F.xxhash64("text")).join(side, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_th")), "left")
    parts = F.split("text", "\n")
    kept = F.filter(parts, lambda x, i: ~F.array_contains("places", i))
    text = F.when(F.col("places").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return found.select(
        "doc_id", text.alias("text"), F.coalesce(F.size(parts), F.lit(0)).cast("bigint").alias("n_lines"), F.coalesce(F.size("places"), F.lit(0)).cast("bigint").alias("n_dropped")
    ).withColumns({"n_lines": F.when(F.col("n_lines") < 0, 0).otherwise(F.col("n_lines")), "n_dropped": F.when(F.col("n_dropped") < 0, 0).otherwise(F.col("n_dropped"))})
