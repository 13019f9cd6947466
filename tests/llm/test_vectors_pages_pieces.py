"""Vectors, pages and pieces against brute force, planted cases and the library of the format."""

import html
import os
import re

import numpy as np
import pytest
import sentencepiece

from cairn.llm import embeddings, html_text, pieces
from cairn.llm.queries import PIECES

# --- vectors ---------------------------------------------------------------------


def vectors():
    rng = np.random.default_rng(2)
    rows, i = [], 0
    for label in (0, 1, None):
        for _ in range(30):
            centre = rng.standard_normal(24)
            for _ in range(int(rng.integers(1, 9))):
                v = centre + rng.standard_normal(24) * rng.choice([0.02, 0.1, 0.2])
                rows.append((i, [float(np.float32(x)) for x in v * rng.choice([1, 1e-3, 50])], label, "x", 1))
                i += 1
    rows += [(i + k, rows[k][1], rows[k][2], "x", 1) for k in range(0, 40, 3)]
    i += 60
    odd = [None, [], [0.0] * 24, [float("nan")] + [1.0] * 23, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23, [1.0, 2.0], [2.0, 4.0], [-0.0, 3.0], [0.0, 3.0]]
    rows += [(i + k, v, 0, "x", 1) for k, v in enumerate(odd)]
    return [*rows, (None, rows[0][1], 0, "x", 1), (0, rows[0][1], 0, "x", 1)]


def plain_links(rows, cosine):
    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        a = np.array(v, dtype="float64")
        return a / np.linalg.norm(a)

    units = [unit(v) for _, v, *_ in rows]
    n = len(rows)
    near = [[j for j in range(n) if j != i and rows[i][2] is not None and rows[i][2] == rows[j][2] and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= cosine] for i in range(n)]
    component = [None] * n
    for i in range(n):
        if component[i] is None:
            found, todo = {i}, [i]
            while todo:
                for j in near[todo.pop()]:
                    if j not in found:
                        found.add(j)
                        todo.append(j)
            low = min((rows[j][0] for j in found if rows[j][0] is not None), default=None)
            for j in found:
                component[j] = (low,)
    return [(rows[i][0], len(near[i]), component[i][0]) for i in range(n)]


@pytest.mark.parametrize(("chunk", "width"), [(4096, 4.0), (3, 1.5)])
def test_links_equal_brute_force(spark, monkeypatch, chunk, width):
    monkeypatch.setattr(embeddings, "CHUNK", chunk)
    rows = vectors()
    given = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, n string, rep int").repartition(3)
    found = embeddings.near_vectors(given).collect()
    want = plain_links(rows, 0.98)
    assert sorted(map(str, ((r.vec_id, r.n_links, r.component_id) for r in found))) == sorted(map(str, want))
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)
    assert any(n > 3 for _, n, _ in want)


def test_no_vectors(spark):
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).collect() == []


# --- pages ------------------------------------------------------------------------

PAGES = "page_id bigint, url string, html string, text string, host int"


def texts(spark, rows):
    given = spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], PAGES).repartition(3)
    return {r.page_id: r.text for r in html_text.extract(given).collect()}


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (None, ""),
        ("", ""),
        ("just text &amp; more\n\n text", "just text & more text"),
        ("<body><nav>m</nav><article><h1>A &amp; B</h1><p>one<b>two</b>\n three<br>four<p>five <a href=x>link</a>.</article><footer>z", "A & B\nonetwo three four\nfive link."),
        ("<article><p>a<aside>no</aside><div class='share-bar'>S</div><ul><li>i<li>j</ul><div id=comments><p>c</p></div><form>f</form>tail", "a\ni\nj\ntail"),
        ("<article><p>x<script>var a='</p><p>no';</script> y<!-- <p>no</p> --><style>p{}</style></p></article>", "x y"),
        ("<main><section><p>&#233;&eacute;&nbsp;z</p></section></main><div class=ad>no</div>", "éé z"),
        ("<div><p>kept</p><div class='cookie-notice'>no</div><header>no</header></div>", "kept"),
        ("<ARTICLE><P title='a > b'>Up</P></ARTICLE>", "Up"),
        ("<article><p>1 < 2 and <unclosed", "1 < 2 and <unclosed"),
        ("<article><p>" + "w " * 100_000 + "</p></article>", ("w " * 100_000).strip()),
    ],
)
def test_main_text(spark, source, text):
    page = html_text.Page(source or "")
    assert "\n".join(t for t, _ in page.main_blocks()) == text


LONG = "Words of the article that go on for a while. " * 3


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (f"<div class='content with-sidebar'><p>{LONG}</p></div>", LONG.strip()),
        (f"<main class=no-sidebar><p>{LONG}</p></main><div class=sidebar>no</div>", LONG.strip()),
        (f"<div class='post comments-closed'><p>{LONG}</p><div class='comments'>no</div></div>", LONG.strip()),
        (f"<article><p>{LONG}</p><h2 id=side-effects>Side effects</h2><section id=related-work><p>Before</p></section><p class=notice-period>A month<p class=side>B</article>", f"{LONG.strip()}\nSide effects\nBefore\nA month\nB"),
        (f"<div class=sidebar><p>{LONG}</p></div><div class=ad>no</div>", LONG.strip()),
        (f"<div><p>{LONG}</p></div><article><p>Teaser</p></article>", f"{LONG.strip()}\nTeaser"),
        (f"<article><p>{LONG} <span class=ad>no</span>end</p></article><p>outside</p>", f"{LONG}end"),
        (f"<p>{LONG}</p><div hidden>{LONG * 3}</div>", LONG.strip()),
    ],
)
def test_names_and_article_tags_are_evidence(source, text):
    assert "\n".join(t for t, _ in html_text.Page(source).main_blocks()) == text


def test_the_tree_of_a_host_removes_what_repeats(spark):
    pages = [
        (i, f"https://h.example/{i}", f"<body><div class=top>Same words on every page</div><div class=story><p>Story {i} begins.</p><p>It ends {i * i}.</p></div><div class=end>The same end</div></body>")
        for i in range(8)
    ]
    other = [(100 + i, f"https://few.example/{i}", "<body><div class=top>Same words on every page</div></body>") for i in range(2)]
    found = texts(spark, pages + other + [(8, "https://h.example/8", None), (None, None, "<p>x"), (3, "https://h.example/3", pages[3][2])])
    assert all(found[i] == f"Story {i} begins.\nIt ends {i * i}." for i in range(8))
    assert found[100] == "Same words on every page" and found[8] == "" and found[None] == "x"


def test_copies_of_an_article_stay(spark):
    page = "<body><article><div class=body><p>One story.</p></div></article></body>"
    assert set(texts(spark, [(i, f"//h.example/{i}", page) for i in range(9)]).values()) == {"One story."}


def test_near_copies_of_an_article_stay(spark):
    shared = [f"Paragraph {k} of the story." for k in range(11)]
    menu = "<div class=top>Same words on every page</div>"
    pages = [[*shared[:5], f"Only here: {i}.", *shared[5:]] for i in range(9)]
    rows = [(i, f"//n.example/{i}", f"<body>{menu}<div class=body>{''.join(f'<p>{t}</p>' for t in page)}</div></body>") for i, page in enumerate(pages)]
    assert texts(spark, rows) == {i: "\n".join(page) for i, page in enumerate(pages)}


def test_given_pages_lose_nothing_of_their_article(spark):
    path = "/root/testdata/sf0.001/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    given = spark.read.parquet(path)
    sources = {r.page_id: r.html for r in given.collect()}
    for r in html_text.extract(given).collect():
        article = re.search("<article>(.*?)(</article>|$)", sources[r.page_id], re.DOTALL)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub("</?b>", "", b.replace("<br>", " ")))).strip() for b in re.split("</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


# --- pieces -----------------------------------------------------------------------

TEXTS = [
    None, "", " ", "  ", "a  b", "   leading", "trail   ", "\n\n x\ty\r\n", "日本語テキスト🙂 emoji \x00 nul", "a" * 300, "hello world!!", " " * 40 + "x" + " " * 31,
    "def f(x):\n        return x", "été ñandú ß", "0123456789" * 5, "​zero width", "don't stop", " ".join(" " * n + "w" for n in range(40)),
    "word " * 30_000, "same", "same",
]


@pytest.mark.skipif(not os.path.exists(PIECES), reason="no piece model")
def test_pieces_equal_the_library_and_round_trip(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = np.random.default_rng(1)
    letters = list("aeiounrstlmdch  ▁éß.,\n你の")
    drawn = ["".join(rng.choice(letters, int(rng.integers(1, 60)))) for _ in range(400)]
    given = TEXTS + drawn
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(given)], "doc_id bigint, text string, n_tokens int, ids string").repartition(3)
    coded = pieces.encoded(docs, PIECES)
    found = {r.doc_id: r for r in coded.collect()}
    assert len(found) == len(given)
    back = {r.doc_id: r.text for r in pieces.decoded(coded, PIECES).collect()}
    for i, text in enumerate(given):
        assert found[i].ids == library.encode(text or ""), repr(text)
        assert found[i].n_tokens == len(found[i].ids)
        assert back[i] == (text or "").replace("▁", " ") and found[i].exact == ("▁" not in (text or ""))
    assert pieces.encoded(docs.limit(0), PIECES).collect() == []
    little = pieces.encoded(docs, PIECES, kept_words=3, slice_chars=7)  # less memory, the same pieces
    assert sorted(map(str, little.collect())) == sorted(map(str, coded.collect()))


def test_decoding_any_ids(spark):
    if not os.path.exists(PIECES):
        pytest.skip("no piece model")
    model = pieces.read_model(open(PIECES, "rb").read())
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = np.random.default_rng(0)
    for _ in range(200):
        ids = rng.choice([*range(3, 400), 13, 28705, 9000], int(rng.integers(0, 12)))
        want = library.decode([int(i) for i in ids])
        got = model.decode(ids.astype("int64"), np.array([len(ids)]))[0]
        if "�" not in want + got:
            assert got == want


def unigram_model():
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.trainer_spec.model_type = 1
    proto.normalizer_spec.name, proto.normalizer_spec.remove_extra_whitespaces = "identity", False
    proto.normalizer_spec.add_dummy_prefix = True
    rng = np.random.default_rng(4)
    made = {"▁", *"abcd", "▁▁"} | {"▁" * int(rng.integers(0, 2)) + "".join(rng.choice(list("abcd"), int(rng.integers(1, 6)))) for _ in range(60)}
    for piece, kind in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        proto.pieces.add(piece=piece, score=0, type=kind)
    for piece in sorted(made - {""}):
        proto.pieces.add(piece=piece, score=float(-rng.uniform(1, 9)), type=1)
    return proto.SerializeToString()


def test_unigram_models():
    data = unigram_model()
    model, library = pieces.read_model(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("abcd "), int(rng.integers(1, 40)))) for _ in range(300)]
    ids, counts = model.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == library.encode(texts)


def page_text(source):
    from cairn.llm.html_text import Page

    return "\n".join(text for text, _ in Page(source).main_blocks())


def test_apostrophes_in_unquoted_attributes():
    assert page_text("<article><p title=don't>Hello world. It's here.</p><p>More</p></article>") == "Hello world. It's here.\nMore"
    assert page_text("<article><p title = 'a > b' x=\"c>\">One</p></article>") == "One"


def test_a_form_around_the_page_is_no_form():
    assert page_text("<form id=aspnetForm><div><p>The text of the page, which is long.</p></div><input value=x></form>") == "The text of the page, which is long."
    assert page_text("<article><p>The text of the page, which is long.</p><form>Write to us</form></article>") == "The text of the page, which is long."


def test_comments_beside_a_short_article():
    remarks = "".join(f"<p>Remark number {k} is longer than the article.</p>" for k in range(9))
    assert page_text(f"<article><p>Short.</p></article><section class=user-comments>{remarks}</section>") == "Short."
    assert page_text(f"<nav class=x>a</nav><div class='main-navigation-links'>b</div><article><p>Short.</p></article><div class=reader-comments>{remarks}</div>") == "Short."


def test_tags_without_an_end_are_read_once():
    import time

    began = time.perf_counter()
    assert page_text("<p>text</p>" + "<a " * 350_000).startswith("text\n<a <a")
    assert page_text("<p>a</p><!-- b <i> <a " + "x" * 10) == "a"
    assert page_text("<p>a</p>b <!-- c") == "a\nb"
    assert time.perf_counter() - began < 5
