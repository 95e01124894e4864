"""WARC round trips and salvage, and HTML extraction."""

import hashlib

import numpy as np

from panelmill.llm import html_extract, warc

PAGES = [
    (3, "http://a/", "x" * 200), (1, "http://b/ü?q=1 2", "x" * 200), (2, None, "x" * 200), (4, "http://c/", None), (5, "http://d/", ""), (6, "u", "short"), (7, "u", "short"),
    (8, "u", "WARC/1.1\r\nnot a record\r\n\r\n" * 20), (9, "u", "\x1f\x8b\x08é" * 5000), (None, "n", "y" * 150), (10, "n", "y" * 150), (11, "e", "z" * 120), (11, "e", "z" * 120),
]
SCHEMA = "page_id bigint, url string, html string, row int, digest string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def test_write_and_read(spark, tmp_path):
    warc.write_archives(pages(spark, PAGES), str(tmp_path / "w"), file_bytes=2000)
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert len(got) == len(PAGES) and all(r["reason"] is None for r in got)
    first = {}
    for i, _, h in PAGES:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    for r in got:
        html = next(h or "" for i, _, h in PAGES if i == r["page_id"])
        assert (r["payload_bytes"], r["payload_digest"]) == (len(html.encode()), hashlib.sha256(html.encode()).hexdigest())
        again = len(html.encode()) >= 100 and r["page_id"] != first[html]
        if r["page_id"] != 11:
            assert (r["record_type"], r["refers_to"]) == (("revisit", first[html]) if again else ("response", None))
    assert sorted(r["record_type"] for r in got if r["page_id"] == 11) == ["response", "revisit"]
    assert warc.write_and_read(pages(spark, [])).count() == 0


def member(i, text):
    return warc._member(warc.response_record(i, "http://x/", text.encode(), hashlib.sha256(text.encode()).hexdigest()))


def test_salvage_recovers_what_follows_damage():
    rng = np.random.default_rng(1)
    parts = [member(i, f"page {i} " + "".join(map(chr, rng.integers(97, 123, 400)))) for i in range(6)]
    whole = b"".join(parts)
    assert [r["page_id"] for *_, r in warc.salvage(whole)] == list(range(6))
    for damage in ("flip", "cut", "junk"):
        middle = bytearray(parts[2])
        if damage == "flip":
            middle[40] ^= 255
        bad = bytes(middle[:60]) if damage == "cut" else bytes(middle) if damage == "flip" else b"??" * 30
        data = parts[0] + parts[1] + bad + b"".join(parts[3:])
        found = list(warc.salvage(data))
        assert [r["page_id"] for *_, r in found if r] == [0, 1, 3, 4, 5]
        (gap,) = [g for g in found if g[2]]
        assert gap[:2] == (len(parts[0]) + len(parts[1]), len(parts[0]) + len(parts[1]) + len(bad))
    assert list(warc.salvage(b"")) == [] and list(warc.salvage(b"rubbish"))[0][:2] == (0, 7)
    assert [bool(r) for *_, r in warc.salvage(whole[:-9])] == [True] * 5 + [False]


def test_salvage_plain_and_wrong_digest():
    text = b"<p>hi</p>"
    good = warc.response_record(1, "http://x/", text, hashlib.sha256(text).hexdigest())
    wrong = warc.response_record(2, "http://x/", text, "0" * 64)
    found = list(warc.salvage(good + wrong + good))
    assert [(r or {}).get("page_id") for *_, r in found] == [1, None, 1]
    assert found[1][:3] == (len(good), len(good) + len(wrong), "digest does not fit")


ARTICLE = (
    '<html><head><title>t</title><style>p{{}}</style></head><body><nav><ul><li><a href="/a">menu one</a></li><li><a href="/b">menu two</a></li></ul></nav>'
    '<div class="ad">buy {0} now</div><article><h1>Head {0} &amp; more</h1><p>First   words {0}, with <b>bold</b> ones and more of them, so that it is long.<br>'
    "<p>Second paragraph about {0}; it goes on, as paragraphs of articles do, for some lines.</p><script>var a='</p>'</script></article><footer>&copy; site {0}</footer></body></html>"
)


def test_extract(spark):
    rows = [(i, f"u{i}", ARTICLE.format(f"topic{i}")) for i in range(60)]
    df = pages(spark, rows)
    model = html_extract.train(df)
    odd = [(100, None, None), (101, "u", ""), (102, "u", "<div><p>unclosed <a href='x"), (103, "u", "<div>" * 20000 + "deep"), (104, "u", "<nav>only menu</nav>")]
    got = {r["page_id"]: r for r in html_extract.extract(pages(spark, rows + odd), model).collect()}
    for i in range(60):
        w = f"topic{i}"
        assert got[i]["text"] == (
            f"Head {w} & more First words {w}, with bold ones and more of them, so that it is long. "
            f"Second paragraph about {w}; it goes on, as paragraphs of articles do, for some lines."
        )
        assert got[i]["n_chars"] == len(got[i]["text"])
    assert got[100]["text"] == got[101]["text"] == got[104]["text"] == "" and got[100]["n_chars"] == 0
    assert html_extract.train(df.limit(0)) is None and html_extract.extract(df.limit(0), None).count() == 0
    plain = {r["page_id"]: r["text"] for r in html_extract.extract(pages(spark, odd), None).collect()}
    assert plain[103] == "deep" and plain[104] == ""


def test_decoding_never_contradicts():
    nodes = html_extract.parse("<div><p>a</p><div><p>b</p><p>c</p></div></div><p>d</p>")
    rng = np.random.default_rng(4)
    for _ in range(200):
        p = rng.random(len(nodes))
        labels = html_extract.decode(nodes, p)
        at = {id(n): i for i, n in enumerate(nodes)}
        assert all(labels[at[id(n.up)]] for n, y in zip(nodes, labels, strict=True) if y and n.up)
        # Brute force over all labellings with an accepted page.
        best, cost = None, -1e18
        for m in range(1 << (len(nodes) - 1)):
            y = [True] + [bool(m >> k & 1) for k in range(len(nodes) - 1)]
            if all(y[at[id(n.up)]] for n, v in zip(nodes, y, strict=True) if v and n.up):
                c = sum(np.log(q if v else 1 - q) for q, v in zip(p[1:], y[1:], strict=True))
                best, cost = (y, c) if c > cost else (best, cost)
        assert labels == best


def test_extract_without_article_element(spark):
    """Articles in plain div elements, and pages of plain paragraphs, among pages with and without an article element."""
    text = "Head of it all First words of a story, with more of them, so that it is long. Second paragraph of the story; it goes on, as paragraphs do, for some lines."
    body = "<h1>Head of it all</h1><p>First words of a story, with more of them, so that it is long.</p><p>Second paragraph of the story; it goes on, as paragraphs do, for some lines.</p>"
    menu, foot = '<nav><ul><li><a href="/a">menu one</a></li><li><a href="/b">menu two</a></li></ul></nav><div class="ad">buy now</div>', "<footer>&copy; site</footer>"
    odd = [f"<html><body>{menu}{a}{body}{b}{foot}</body></html>" for a, b in (('<div id="content">', "</div>"), ('<div class="post">', "</div>"), ("<div>", "</div>"), ("", ""))]
    odd += [f"<html><body>{body}</body></html>", text, "<html><body><nav>only menu</nav><div class='ad'>buy now</div></body></html>"]
    rows = [(i, "u", ARTICLE.format(f"topic{i}")) for i in range(40)] + [(50 + i, "u", odd[0]) for i in range(20)]
    model = html_extract.train(pages(spark, rows))
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages(spark, [(100 + i, "u", h) for i, h in enumerate(odd)]), model).collect()}
    assert [got[100 + i] for i in range(len(odd))] == [text] * 6 + [""]
