"""Packing, sentence pieces, line dedup and exact dedup against brute force and on odd rows."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from panelmill.llm import exact_dedup, line_dedup, packing, sentence_pieces

SCHEMA = "doc_id bigint, text string, sha string, n bigint, block int, word string, size int"
LONG = "lorem ipsum, dolor SIT amet 42! " * 4000
ROWS = [
    (1, "Alpha beta\nshared line of some words\nown one"), (2, "ALPHA beta\nshared line of some words\nown one"), (3, None), (4, ""),
    (5, "  a  b\n\nc ▁d é中\x00 don't 12ab"), (6, LONG), (7, LONG.lower()), (8, "shared line of some words\nuser 17 said hello there friend"),
    (9, "x\nshared line of some words\nuser 23 said hello there friend"), (9, "x\nshared line of some words\nuser 23 said hello there friend"),
    (None, "no id"), (None, "NO ID"), (10, "user 5 said hello there friend\ny"), (11, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 20),
]


@pytest.fixture(scope="module")
def docs(spark):
    # Extra columns have the names that operators use inside.
    return spark.createDataFrame([(i, t, "x", 5, 0, "w", 1) for i, t in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_exact_dedup(docs, empty):
    got = exact_dedup.exact_dedup(docs).collect()
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[lower(t)].append(i)
    want = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha, once = hashlib.sha256(t.encode()).hexdigest(), set()
        for i in ids:
            want[(i, keep, len(ids), i == keep and i not in once, sha)] += 1
            once.add(i)
    assert Counter(tuple(r) for r in got) == want
    assert exact_dedup.exact_dedup(empty).count() == 0
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(groups)


def test_golomb_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        values = np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        k, blob = exact_dedup.rice_encode(values)
        assert (exact_dedup.rice_decode(k, n, blob) == values).all()
    assert len(blob) < 8 * 1000


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.word_bpe_path())
    rows = packing.pack(docs).collect()
    by = defaultdict(list)
    for r in rows:
        assert r["length"] & (r["length"] - 1) == 0 and r["length"] <= 2048 and r["offset"] == 0
        assert zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"] and 1 << r["bucket"] == r["length"]
        by[r["doc_id"]].append(r)
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    for i, t in ROWS:
        want = tok.encode(t or "", add_special_tokens=False).ids + [1]
        mine = sorted(by[i], key=lambda r: (r["start"], r["sequence_id"]))
        if Counter(k for k, _ in ROWS)[i] == 1:
            assert [x for r in mine for x in r["ids"]] == want and {r["doc_tokens"] for r in mine} == {len(want)}
            assert len(mine) == len(want) // 2048 + bin(len(want) % 2048).count("1")
    assert packing.pack(empty).count() == 0


def test_sentence_pieces(docs, empty, spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.piece_path())
    got = sentence_pieces.with_decoded(sentence_pieces.encode(docs)).collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == Counter((i, tuple(sp.encode(t or ""))) for i, t in ROWS)
    assert Counter(r["text"] for r in got) == Counter(sp.decode(sp.encode(t or "")) for i, t in ROWS)
    assert sentence_pieces.encode(empty).count() == 0


def test_viterbi_fold(spark):
    """Against dynamic programming over the same scores."""
    v = sentence_pieces.vocabulary(sentence_pieces.piece_path())
    words = ["▁hello", "▁internationally", "ab", "zzzzzz", "▁the"]
    df = spark.createDataFrame([(w,) for w in words], "word string").groupBy("word").count()
    got = {r["word"]: r["ids"] for r in sentence_pieces.encode_words(df, sentence_pieces.piece_path(), "viterbi").collect()}
    for w in words:
        best = [0.0] + [-1e18] * len(w)
        for j in range(1, len(w) + 1):
            for i in range(max(0, j - v.longest), j):
                found = v.pieces.get(w[i:j])
                s = best[i] + (found[1] if found else -1e6 if j - i == 1 else -1e18)
                best[j] = max(best[j], s)
        assert sum(v.pieces[v.names[i]][1] for i in got[w]) == best[-1]


def test_line_dedup(docs, empty):
    got = line_dedup.line_dedup(docs).collect()
    assert len(got) == len(ROWS)
    texts = defaultdict(list)
    for r in got:
        texts[r["doc_id"]].append(r)
    # In three different texts (two that differ by case count as two): the line, and the template with a field.
    assert texts[1][0]["text"] == "Alpha beta\nown one" and texts[1][0]["n_dropped"] == 1
    assert [r["text"] for r in texts[9]] == ["x", "x"]
    assert texts[8][0]["text"] == "" and texts[10][0]["text"] == "y"
    assert texts[3][0]["text"] is None and texts[4][0]["text"] == "" and texts[6][0]["n_dropped"] == 0
    assert line_dedup.line_dedup(empty).count() == 0


def test_line_dedup_generalises_words(spark):
    names = "anna ben carl dora emil fred gina hans".split()
    rows = [(i, f"posted today by {n} in the evening news section\nbody of text {n} {n}{n} is different from others {i}") for i, n in enumerate(names)]
    rows.append((99, "posted today by our own staff without any news"))
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    # Both lines have one template each; the last row's line shares their leaf, but not their constants.
    assert all(got[i] == "" for i in range(8))
    assert got[99] == rows[-1][1]


def test_line_dedup_finds_rare_templates_in_a_large_leaf(spark):
    """A template in 1% of a leaf of 2,000 lines, with a field of words that other lines of the leaf have there too."""
    rng = np.random.default_rng(5)
    words = [f"w{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]}" for i in range(40)]
    noise = [(i, f"This is the {' '.join(rng.choice(words, 9))}") for i in range(2000)]
    rare = [(5000 + i, f"This is the {words[i]} page of our {words[i + 20]} shop for friends") for i in range(20)]
    few = [(6000 + i, f"This is the {w} note that only three {w} texts ever hold") for i, w in enumerate(words[:3])]
    two = [(7000 + i, f"This is the {w} remark that just two {w} texts did hold") for i, w in enumerate(words[:2])]
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.line_dedup(spark.createDataFrame(noise + rare + few + two, "doc_id bigint, text string")).collect()}
    t = np.array([[words.index(w) for w in line.split(" ")[3:]] for _, line in noise])
    same = {i: t == t[i] for i in range(len(t))}
    near = {i: [j for j in np.flatnonzero(same[i].sum(1) >= 6) if j != i] for i in same}
    want = {i: int(any((same[i][j] & same[i][k]).sum() >= 6 for j in near[i] for k in near[i] if j != k)) for i in near}
    assert {i: got[i] for i in want} == want
    assert all(got[i] == 1 for i, _ in rare + few) and not any(got[i] for i, _ in two)


def test_line_dedup_splits_at_any_white_space(spark):
    """A tab-separated line, and one line with CRLF, LF, double blanks and a tab before a field."""
    rows = [(i, f"Home\tNews\tSport\tMail\town {w}") for i, w in enumerate(("anna", "ben", "carl"))]
    rows += [(i + 10, f"{w}\nHome\tNews\tSport\tMail\n{w}{w}") for i, w in enumerate(("dora", "emil", "fred"))]
    rows += [(20, "gina\r\nread all of page 12 here\r\nend"), (21, "hans\nread all of page 13 here\nend"), (22, "ida\nread  all of\tpage\t14 here "), (23, "jon\n\tread all of page 7\there\r")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [got[i] for i in (10, 11, 12)] == ["dora\ndoradora", "emil\nemilemil", "fred\nfredfred"]
    assert got[20] == "gina\r\nend" and got[21] == "hans\nend" and got[22] == "ida" and got[23] == "jon"


def test_line_dedup_masks_a_line_once(docs):
    """Spark pushes a filter on masked tokens below the masking, which then runs twice for every line."""
    plan = line_dedup._lines(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<*>") == 1


def test_line_dedup_compares_lines_of_more_tokens_than_a_mask_holds(spark):
    """Lines of 130 tokens: three with 91 equal places (the least that a template has), three with 90."""
    def lines(word, fields):
        return [" ".join(["See", "all", word] + [f"{word}{'abc'[k]}{'xyzuvw'[i % 6]}{'klmnop'[i // 6 % 6]}{'rst'[i // 36 % 3]}" if i < fields else f"c{'ghij'[i % 4]}" for i in range(127)]) for k in range(3)]

    rows = list(enumerate(lines("long", 39))) + [(10 + i, t) for i, t in enumerate(lines("short", 40))]
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 10: 0, 11: 0, 12: 0}


def test_line_dedup_compares_a_bucket_in_full_before_it_splits_it(spark, monkeypatch):
    """A leaf of 300 lines without a template, and two lines among them that make one with a third."""
    rng = np.random.default_rng(9)
    words = [f"w{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]}" for i in range(100)]
    rows = [(i, f"This is the {' '.join(rng.choice(words, 17))}") for i in range(300)]
    rows += [(1000 + i, f"This is the {w} page of our shop for friends that like to read of {w} and {w} too") for i, w in enumerate(words[:3])]
    split = []
    monkeypatch.setattr(line_dedup, "_extended", lambda *a: split.append(1))
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [i for i, n in sorted(got.items()) if n] == [1000, 1001, 1002] and not split


@pytest.mark.parametrize("full", [4, 2_048])
def test_line_dedup_splits_and_compares_alike(spark, monkeypatch, full):
    """Large buckets that are split drop the same lines as those compared in full."""
    monkeypatch.setattr(line_dedup, "FULL", full)
    test_line_dedup_finds_rare_templates_in_a_large_leaf(spark)


def test_exact_dedup_lowers_in_arrow_as_in_spark(spark):
    import pyarrow as pa

    texts = ["", "ABCXYZ abc", "ÀÉÖ ẞ İ Straße ÑandU", "a\x00B\n\tC", "日本Go", None]
    got = exact_dedup._lowered(pa.record_batch([pa.array(range(6)), pa.array(texts, pa.string())], ["doc_id", "text"])).column(1).to_pylist()
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    assert got == [lower(t) for t in texts] == [r[0] for r in df.orderBy("i").select(exact_dedup.normalised(df["text"])).collect()]
    # Texts are read and compared once, not once for each part of hot_join.
    plan = exact_dedup.exact_dedup(df.selectExpr("i AS doc_id", "text"))._jdf.queryExecution().optimizedPlan().toString()
    assert "body" not in plan
