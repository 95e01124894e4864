"""The two classifiers on given tables, and on odd rows."""

import os
import zlib

import numpy as np
import pytest

from panelmill.llm import quality, toxicity
from panelmill.llm.common import table

FOLDER = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, "word " * 50000), (None, "no id"), (4, "x"), (4, "x")]


def odd_rows(spark):
    return spark.createDataFrame([(i, t, 0.5, "y", 1) for i, t in ODD], "doc_id bigint, text string, score double, y string, label int")


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize("module", [toxicity, quality])
def test_odd_rows(spark, module):
    docs = odd_rows(spark)
    rows = [(i, i % 2, 1 - i % 2) for i in range(1, 40)] + [(None, 1, 1), (2, None, None), (1, 0, 0), (1, 1, 1)]
    model = module.train(docs, labels_of(spark, rows))
    got = module.score(docs, model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 4}) == 1
    none = module.train(docs, labels_of(spark, []))
    assert {r["score"] for r in module.score(docs, none).collect()} == ({0.0} if module is toxicity else {1.0})
    assert module.score(docs.limit(0), none).count() == 0
    kept = toxicity.drop_toxic(docs, labels_of(spark, [])) if module is toxicity else quality.keep_good(docs, labels_of(spark, []))
    assert kept.columns == docs.columns and kept.count() == len(ODD)


def test_counterfactual_penalty():
    """A group's name that goes with the label by chance loses its weight; an insult keeps its own."""
    rows = []
    for i in range(600):
        words = {f"filler{i % 50}", "the"} | ({"idiot"} if i % 3 == 0 else set()) | ({"muslims"} if i % 3 == 0 and i % 2 or i % 31 == 0 else set())
        swapped = toxicity.counterfactual(words)
        rows.append((toxicity._ids(words), None if swapped is None else toxicity._ids(swapped), int(i % 3 == 0)))

    def gap(model):
        w, _ = model
        return w[toxicity._ids({"muslims"})].sum() - w[toxicity._ids({"christians"})].sum()

    fair = toxicity.fit(rows)
    free = toxicity.fit([(a, None, y) for a, _, y in rows])
    assert abs(gap(fair)) < 0.5 * abs(gap(free))
    w, b = fair
    assert w[toxicity._ids({"idiot", "the"})].sum() + b > 0 > w[toxicity._ids({"muslims", "the"})].sum() + b


def test_mentions_name_a_group_and_another_or_none():
    pair = toxicity.mentions("Der Garten ist schön. The house is old! Une maison.")
    assert pair == toxicity.mentions("Der Garten ist schön. The house is old! Une maison.") and len(pair[0] ^ pair[1]) in (1, 2)
    assert (pair[0] ^ pair[1]) <= {t for row in toxicity.IDENTITY_TERMS for t in row}
    assert toxicity.mentions(None) is None and toxicity.mentions(" .!\n") is None
    seen = [toxicity.mentions(f"text number {i}") for i in range(3000)]
    assert {len(b) - len(a) for a, b in seen} == {-1, 0}  # another term, or none
    named = set().union(*(a for a, _ in seen))
    assert {t for row in toxicity.IDENTITY_TERMS for t in row} <= named


def test_made_up_mentions_take_the_weight_off_group_names():
    """Toxic words that begin like a group's name would lend it weight; the penalty takes it off again."""
    rows, texts = [], []
    for i in range(900):
        bad = i % 3 == 0
        text = f"filler{i % 50} the {'muslxx idiot foreixx immigxx' if bad else 'garden house'} word{i % 40}."
        texts.append(text)
        pair = toxicity.mentions(text)
        rows.append((toxicity._ids(toxicity._words(text)), None, int(bad), *map(toxicity._ids, pair)))
    fair, free = toxicity.fit(rows, penalty=5.0), toxicity.fit(rows, penalty=0.0)
    calm = [t for i, t in enumerate(texts) if i % 3]
    assert toxicity.mention_gap(fair, calm) < 0.5 * toxicity.mention_gap(free, calm)
    w, b = fair
    assert w[toxicity._ids({"idiot", "the"})].sum() + b > 0 > w[toxicity._ids({"muslims", "the", "garden"})].sum() + b


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the given tables")
def test_toxicity_held_out(spark):
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).join(labels, "doc_id").where("held_out AND toxic IS NOT NULL").toPandas()
    bad = got[got["toxic"] == 1]
    assert (got["predicted"] == got["toxic"]).mean() > 0.9 and bad["predicted"].mean() > 0.5
    calm = [r[0] for r in docs.join(labels.where("toxic = 0"), "doc_id").select("text").limit(300).collect()]
    assert toxicity.mention_gap(model, calm) < 0.02


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the given tables")
def test_quality_held_out(spark):
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    got = quality.score(docs, quality.train(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.93


def test_temperature_is_chosen():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] + rng.normal(0, 1, 400) > 0).astype(float)
    net = quality.Network(x[:300], y[:300], x[300:], y[300:])
    assert net.temperature != 1.0 and 0 < net.score(x).min() < net.score(x).max() < 1


def test_scoring_looks_only_at_features_that_carry_weight():
    rng = np.random.default_rng(4)
    w = np.where(rng.random(1 << toxicity.BITS) < 0.02, rng.normal(size=1 << toxicity.BITS), 0).astype(np.float32)
    texts = [None, "", "  ", "Idiot garden idiots GARDENER", "weiße Straßenbahnen über élévateurs 12345678", " ".join(f"word{i}" for i in range(3_000))]
    live = toxicity._Live(w)
    got = toxicity._logits((w, 0.25), texts, live)
    assert np.allclose(got, [w[toxicity._ids(toxicity._words(t))].sum(dtype=np.float64) + 0.25 for t in texts], rtol=0, atol=1e-12)
    assert sum(map(len, live.values())) < 0.1 * sum(len(toxicity._features_of(x)) for x in live)
    word = "straßenbahn"
    assert toxicity._features_of(word) == [zlib.crc32(x) % (1 << toxicity.BITS) for x in [b"w" + word.encode(), *(b"s%d" % n + word[:n].encode() for n in toxicity.STEMS)]]
