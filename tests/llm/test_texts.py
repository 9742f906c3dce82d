"""Quality, language, HTML, media and WARC: held-out accuracy, brute force and round trips."""

import hashlib
import itertools
import random
import tarfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import html, language, media, quality, warc
from tidemark.llm.storage import Reader, opened

SF = "/root/testdata/sf0.01"
DOCUMENTS = "doc_id bigint, text string"


def crc(i):
    return zlib.crc32(str(i).encode())


def test_quality_on_held_out_documents(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    found = quality.op2_quality(spark, SF).collect()
    assert all(r.held_out == (crc(r.doc_id) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    held = [(labels[r.doc_id], r.predicted) for r in found if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in held]) >= 0.97


def test_context_sums_are_brute_force(spark):
    texts = ["a b c b", "", None, "c c a"]
    found = {r.bucket: r for r in quality.context_sums(spark.createDataFrame(list(enumerate(texts)), DOCUMENTS)).collect()}
    seen, index = quality.Buckets(), quality.index_vectors().astype(int)
    want, count = {}, {}
    for t in texts:
        ids = quality.tokens(t or "", seen).tolist()
        for i, b in enumerate(ids):
            count[b] = count.get(b, 0) + 1
            want[b] = want.get(b, 0) + sum(index[ids[j]] for j in range(max(0, i - 2), min(len(ids), i + 3)) if j != i)
    assert {b: r.n for b, r in found.items()} == count
    assert all([r[f"d{k}"] for k in range(quality.DIM)] == list(want[b]) for b, r in found.items())


def test_scores_are_the_network_by_hand(spark):
    """Word vectors, pooling and the two layers again in plain Python, for documents of all lengths."""
    import math
    import re

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").select("doc_id", "text")
    vectors, net = quality.quality_model(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert net.layers is not None
    size = vectors.shape[1]
    average = vectors[-1].astype(float)
    (w, b, u, c), mean, scale = net.layers, np.broadcast_to(net.mean, (2 * size,)), np.broadcast_to(net.scale, (2 * size,))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in quality.score(docs, vectors, net).collect():
        ids, last = [], None
        for word in re.findall(r"\w+|[^\w\s]+", texts[r.doc_id]):
            own = zlib.crc32((word.lower() + ("^" if word.isupper() and len(word) > 1 else "")).encode()) % quality.BUCKETS
            ids.append(quality.REPEAT if own == last else own)
            last = own
        n = len(ids) + quality.PRIOR_WORDS
        x = [(sum(float(vectors[i][k]) for i in ids) + quality.PRIOR_WORDS * average[k]) / n for k in range(size)]
        square = [(sum(float(vectors[i][k]) ** 2 for i in ids) + quality.PRIOR_WORDS * (average[k] ** 2 + 1 / size)) / n for k in range(size)]
        x += [math.sqrt(max(s - m * m, 0)) for s, m in zip(square, x)]
        hidden = [math.tanh(sum((x[k] - mean[k]) / scale[k] * w[k][j] for k in range(2 * size)) + b[j]) for j in range(quality.HIDDEN)]
        z = (sum(h * v for h, v in zip(hidden, u)) + c[0]) / net.temperature
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=2e-3) and r.predicted == int(r.score >= 0.5)


def test_language_on_held_out_documents(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = language.op10_language(spark, SF).collect()
    assert all(r.held_out == (crc(r.doc_id) % 4 == 2) for r in found)
    assert np.mean([lang[r.doc_id] == r.lang_pred for r in found if r.held_out]) >= 0.98


def test_language_without_letters_or_labels(spark):
    docs = spark.createDataFrame([(1, "12 !!", False), (2, None, False), (3, "word", False)], DOCUMENTS + ", held_out boolean")
    assert [(r.lang_pred, r.score) for r in language.identify(docs, {}).collect()] == [("und", 0.0)] * 3
    two = {r.doc_id: r.lang_pred for r in language.identify(docs, {"x": b" word words worded ", "y": b" nichts davon hier "}).collect()}
    assert two == {1: "und", 2: "und", 3: "x"}


@pytest.mark.parametrize("seed", range(30))
def test_minimum_cut_is_brute_force(seed):
    r = random.Random(seed)
    n = r.randint(1, 8)
    terminal = [r.choice((-1, 1)) * r.random() for _ in range(n)]
    ties = [(a, b, r.random()) for a, b in itertools.combinations(range(n), 2) if r.random() < 0.6]
    cost = lambda side: sum(max(0, t) if not s else max(0, -t) for t, s in zip(terminal, side)) + sum(w for a, b, w in ties if side[a] != side[b])
    assert cost(html.minimum_cut(terminal, ties)) == pytest.approx(min(map(cost, itertools.product((False, True), repeat=n))))


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>Site name</header><nav class="main-menu"><ul><li><a href="/a">Home</a></li><li>About</li></ul></nav>
<div class="cookie-notice">We use cookies on this site, all of them.</div>
<main><article><h1>A &lt;title&gt; &amp; more</h1><p>First   paragraph<br>goes on.<p>Second one, <a href="#">linked</a> &eacute;&#233;.
<aside class="sidebar">Related: other things to read.</aside><form><label>Mail</label><input></form><p>To.</p></article></main>
<section id="comments"><p>Great article, says a reader with many words to say about it.</p></section><footer>&copy; us</footer></body></html>"""


def test_html_keeps_the_article_only():
    assert html.main_text(PAGE) == "A <title> & more\nFirst paragraph goes on.\nSecond one, linked éé.\nTo."
    assert html.main_text("") == html.main_text("<nav>x</nav>") == html.main_text("<!-- <p>x</p>") == ""


WRAPPED = "<nav><a href=/>Home</a></nav><article><h1>The title here</h1><p>This is the first paragraph of the story, with words.</p><p>Short one.</p></article><footer>&copy; x</footer>"


@pytest.mark.parametrize("names", ["single", "single no-sidebar", "post has-header-image", "page comments-open", "theme layout-share", "content-with-sidebar"])
def test_names_of_the_whole_page_ban_nothing(names):
    for page in (f'<body class="{names}">{WRAPPED}</body>', f'<body><div class="{names}">{WRAPPED}</div></body>'):
        assert html.main_text(page) == "The title here\nThis is the first paragraph of the story, with words.\nShort one."


@pytest.mark.parametrize(
    "page, text",
    [
        ("plain text only", "plain text only"),
        ("<div><p>Short.</p><p>No.</p></div>", "Short.\nNo."),
        ("<article><header><h1>Title</h1></header><p>Body of text here.</p></article>", "Title\nBody of text here."),
        ("<object>fallback text of it</object><p>more</p>", "fallback text of it\nmore"),
        ("<p>before</p><svg><path><p>after an unclosed svg.</p>", "before\nafter an unclosed svg."),
        ('<p title="a > b">kept a < b & c</p>', "kept a < b & c"),
        ("<aside><article><p>Teaser of another article.</p></article></aside><main><p>The text.</p></main>", "The text."),
        ('<article><p>Text of the article.</p></article><div id="comments"><article><p>A reader says a long thing about all of it.</p></article></div>', "Text of the article."),
        ("<form><div><h1>Head</h1><p>All of the page is in a form, as some servers do.</p></div></form>", "Head\nAll of the page is in a form, as some servers do."),
        ("<article><p>one<select><option>x</select><button>Go</button> two.</article>", "one two."),
        ("<article><p>never closed <b>at all", "never closed at all"),
        ("<p>text<p class='x' ", "text"),
    ],
)
def test_html_of_odd_pages(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize("part", ["<a ", "<p x='", '<a b="', "<", "<div>", "</p>", "<!--", "<svg>", "<title>", "<li><div>", "<table><td>", "&"])
def test_html_is_read_in_linear_time(part):
    import time

    began = time.process_time()
    html.main_text(part * 100_000)
    assert time.process_time() - began < 10


UNMARKED = """<div><div><a href=1>One</a></div><div><a href=2>Two</a></div></div><div><p>The first paragraph is a long one, with many words in it, and it ends here.</p>
<p><a href=x>see this</a> too</p><p>The second paragraph is a long one as well, it has as many words, and it ends here too.</p></div><div><a href=3>About us</a></div>"""


def energy(blocks, weights, side):
    costs = sum(max(0, o) if not s else max(0, -o) for o, s in zip(html.odds(blocks, weights), side))
    return costs + sum(w for a, b, w in html.ties_of(blocks) if side[a] != side[b])


@pytest.mark.parametrize("page", [UNMARKED, WRAPPED, PAGE])
def test_labels_of_whole_pages_are_brute_force(page):
    blocks, weights = html.blocks_of(page), np.array(html.PRIOR)
    side = html.minimum_cut(html.odds(blocks, weights), html.ties_of(blocks))
    assert energy(blocks, weights, side) == pytest.approx(min(energy(blocks, weights, s) for s in itertools.product((False, True), repeat=len(blocks))))


def test_the_cut_changes_labels():
    """A linked line inside an unmarked article is boilerplate to the classifier; its ties keep it."""
    blocks = html.blocks_of(UNMARKED)
    odds = html.odds(blocks, np.array(html.PRIOR))
    side = html.minimum_cut(odds, html.ties_of(blocks))
    at = next(i for i, b in enumerate(blocks) if "see this" in b.text)
    assert odds[at] < 0 and side[at]
    assert [b.text[:3] for b, s in zip(blocks, side) if s] == ["The", "see", "The"]


def article_of(page):
    """The generator's pages, by its own markup: headings and paragraphs of the one article element."""
    import html as entities
    import re

    inside = re.search(r"<article>(.*?)</article>", page or "", re.S)
    parts = re.split(r"</?(?:h1|p)>", re.sub(r"</?b>", "", inside[1].replace("<br>", " "))) if inside else []
    return "\n".join(x for x in (" ".join(entities.unescape(p).split()) for p in parts) if x)


def test_html_query_gives_the_articles(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    found = html.op6_html(spark, SF).collect()
    assert len(found) == len(pages) and all(r.text == article_of(pages[r.page_id]) and r.n_chars == len(r.text) for r in found)


def test_html_learns_from_landmarks(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    weights = html.learn(pages)
    assert np.array_equal(weights, html.learn(pages.unionByName(pages).repartition(5)))  # copies and order teach nothing
    assert np.abs(weights - np.array(html.PRIOR)).max() > 0.5
    none = pages.selectExpr("page_id", "url", "'<p>no landmarks</p>' AS html")
    assert np.allclose(html.learn(none), html.PRIOR) and np.allclose(html.learn(pages.where("false")), html.PRIOR)
    x, y = html.seeds(pages.where("html IS NOT NULL").first().html)
    step = 1e-5
    w = html.fit(x, y)
    loss = lambda w: np.logaddexp(0, x @ w).sum() - y @ (x @ w) + html.STRENGTH / 2 * ((w - np.array(html.PRIOR)) ** 2).sum()
    assert all(loss(w) <= loss(w + d) + 1e-9 for d in np.concatenate([step * np.eye(len(w)), -step * np.eye(len(w))]))


def test_html_does_not_cap_long_pages():
    page = "<article>" + "".join(f"<p>Paragraph {i} has words.</p>" for i in range(5000)) + "</article><footer>f</footer>"
    assert html.main_text(page).count("\n") == 4999


def test_media_round_trip_and_sharing(spark):
    texts = ["", None, "x" * 192, "x" * 193, "same", "same", "ü" * 500, "same" + " " * 9]
    rows = media.write_shards(spark.createDataFrame(list(enumerate(texts)), DOCUMENTS), shard_bytes=2000)
    places = media.canonical(rows)
    read = {r.digest: r for r in media.read_media(media.read_headers(places)).collect()}
    for r in rows.collect():
        payload, n = media.payload_of(texts[r.doc_id] or "")
        got = read[r.digest]
        assert (r.n_bytes, got.payload_bytes, got.payload_sha256) == (n, len(payload), hashlib.sha256(payload).hexdigest())
        assert got.tail_crc32 == zlib.crc32(payload[-16:]) and got.height * got.width == len(payload)
        stored = Reader().read(r.shard, r.offset, r.length)
        assert media.decode(stored) == payload and hashlib.sha256(stored).hexdigest() == r.digest
    shard = rows.first().shard
    system, path = opened(shard)
    with system.open_input_stream(path, compression=None) as f, tarfile.open(fileobj=f, mode="r|") as tar:
        names = [m.name for m in tar]
    assert names and all(n.endswith(".png") for n in names)


def test_media_query_by_hand(spark):
    """Every column of the query again from the texts, the features by plain statistics."""
    import math

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    found = media.op4_media(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.doc_id for r in found) == sorted(texts)
    for r in found:
        raw = texts[r.doc_id].encode()
        payload = raw + b" " * (192 - len(raw) % 192 if len(raw) % 192 or not raw else 0)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        stored = Reader().read(r.shard, r.offset, r.length)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        mean = sum(payload) / len(payload)
        spread = math.sqrt(sum((x - mean) ** 2 for x in payload) / len(payload))
        edge = sum(abs(a - b) for a, b in itertools.pairwise(payload)) / (len(payload) - 1)
        values = dict(x.split("=") for x in r.feature.split(";"))
        assert [float(values[k]) for k in ("mean", "std", "edge")] == pytest.approx([mean, spread, edge], abs=1e-3) and int(values["values"]) == len(set(payload))


def test_warc_round_trip_and_lookup(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 4)
    r = random.Random(1)
    pages = [(i, f"http://h{r.randint(0, 5)}.Example.org/p{r.randint(0, 9)}", f"<p>{'body ' * r.randint(1, 40)}{r.randint(0, 30)}") for i in range(150)]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    lines = warc.write_archives(frame)
    tops = warc.write_index(lines)
    assert lines.count() == 150 and sum(1 for t in tops) >= 1
    found = {x.page_id: x for x in warc.lookup(warc.with_keys(frame), tops).collect()}
    first = {}
    for i, _, h in pages:
        first.setdefault(h, i)
    for i, _, h in pages:
        revisit = len(h) >= 100 and first[h] != i
        assert (found[i].record_type, found[i].refers_to) == (("revisit", first[h]) if revisit else ("response", None))
        assert found[i].payload_digest == hashlib.sha256(h.encode()).hexdigest()
    missing = spark.createDataFrame([("org,example,none)/", 1), ("", None), ("zzz", 5)], "key string, page_id bigint")
    assert warc.lookup(missing, tops).count() == 0


def test_archives_are_whole_warc_files(spark):
    """Read by hand: a warcinfo record first, then HTTP responses and revisits whose lengths and digests are right."""
    import gzip

    page = "<p>" + "long enough to be shared " * 9
    frame = spark.createDataFrame([(1, "http://a/1", page), (2, "http://a/2", page), (3, None, "short ü"), (4, "http://a/4", None)], "page_id bigint, url string, html string")
    records = []
    for uri in {r.file for r in warc.write_archives(frame.coalesce(1)).collect()}:
        system, path = opened(uri)
        with system.open_input_stream(path, compression=None) as f:
            data = gzip.decompress(f.read())
        mine = []
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            assert lines[0] == "WARC/1.1"
            names = dict(x.split(": ", 1) for x in lines[1:])
            n = int(names["Content-Length"])
            mine.append((names, rest[:n]))
            assert rest[n : n + 4] == b"\r\n\r\n"
            data = rest[n + 4 :]
        assert mine[0][0]["WARC-Type"] == "warcinfo" and all(x["WARC-Type"] != "warcinfo" for x, _ in mine[1:])
        records += mine[1:]
    assert len(records) == 4
    for names, block in records:
        http, _, payload = block.partition(b"\r\n\r\n")
        assert names["Content-Type"] == "application/http; msgtype=response" and http.startswith(b"HTTP/1.1 200 OK\r\n")
        if names["WARC-Type"] == "response":
            assert names["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(payload).hexdigest() and f"Content-Length: {len(payload)}".encode() in http
        else:
            assert payload == b"" and names["X-Refers-To-Page"] == "1" and names["X-Page"] == "2"


def test_url_keys():
    assert warc.url_key("HTTPS://User@www.Example.org:443/a/B?c=d#e") == "org,example,www)/a/B?c=d"
    assert warc.url_key("http://x.org:8080") == "org,x:8080)/"
    assert warc.url_key(None) == "" and warc.url_key("http://[bad") == "http://[bad"


def test_language_of_copied_texts_is_learned(spark):
    """A language whose rows are nearly all copies of one text is taught from its different texts, and from all parts of them."""
    docs = spark.range(4000).selectExpr("'xx' AS lang", "if(id < 3940, 'samesame', concat(repeat('filler ', 400), 'tail', translate(id, '0123456789', 'abcdefghij'))) AS text")
    found = {r.passage for r in language.candidates(docs, 10).collect()}
    assert sum("tail" in p for p in found) >= 9


def test_candidates_are_whole_texts_apart_from_other_languages(spark):
    r = random.Random(4)
    own = {l: [" ".join("".join(r.choice(a) for _ in range(6)) for _ in range(200)) for _ in range(3)] for l, a in (("x", "abcde"), ("y", "vwxyz"))}
    shared = "q" * language.PASSAGE
    rows = [(l, t) for l, ts in own.items() for t in ts] + [("x", shared), ("y", shared), ("x", None), (None, "abc"), ("x", own["x"][0])]
    found = language.candidates(spark.createDataFrame(rows, "lang string, text string")).collect()
    for l, ts in own.items():
        assert sorted(f.passage for f in found if f.lang == l) == sorted({p for t in ts for p in language.passages(t)})
    assert "".join(language.passages(own["x"][0])) == own["x"][0]


def test_dictionaries_leave_foreign_passages_out(spark):
    """English under a French label gains nothing from French: it stays out of the dictionary."""
    r = random.Random(6)
    syllables = {"en": ["th", "er", "on", "an", "ing"], "fr": ["eau", "oi", "qu", "le", "eur"]}
    text = lambda l: " ".join("".join(r.choice(syllables[l]) for _ in range(3)) for _ in range(300))
    rows = [("en", text("en")) for _ in range(20)] + [("fr", text("fr")) for _ in range(18)] + [("fr", foreign := text("en"))]
    content = language.dictionaries(spark.createDataFrame(rows, "lang string, text string"))
    assert not any(p.encode() in content["fr"] for p in language.passages(foreign))
    assert len(content["fr"]) > 5000


def by_hand(text, content):
    """The language by an own reading of the method, without the module's functions."""
    import re

    import zstandard

    data = re.sub(r"[\W\d_]+", " ", text.lower()).encode()
    sizes = {}
    for name, c in content.items():
        d = zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        z = zstandard.ZstdCompressor(level=12, dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False)
        sizes[name] = sum(len(z.compress(data[i : i + 512])) for i in range(0, len(data), 512))
    return sizes


def test_language_is_the_smallest_size_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "text", "lang", "pmod(crc32(cast(cast(doc_id AS string) AS binary)), 4) = 2 AS held_out")
    content = language.dictionaries(docs.where("NOT held_out"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    checked = 0
    for r in language.identify(docs, content).where("held_out").collect():
        if r.lang_pred == "und":
            continue
        sizes = by_hand(texts[r.doc_id], content)
        least = sorted(sizes.values())
        assert sizes[r.lang_pred] == least[0]
        if least[0] < least[1]:
            assert r.reliable == (least[1] - least[0] > 0.01 * least[0]) and (r.score > 0) == r.reliable
            checked += 1
    assert checked > 200


def test_equal_sizes_are_rejected_and_go_to_the_first():
    classify = language.classifier({"b": b" the same words ", "a": b" the same words "})
    assert classify("the same words") == ("a", 0.0, False)
    assert language.classifier({"a": b" only one "})("any text") == ("a", 1.0, True)
