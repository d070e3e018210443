import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from postsift.llm import html_extract, language_id, packing, queries, topk, toxicity

DATA = "/root/testdata"


# --- packing ------------------------------------------------------------------------------------


def test_shortest_pack_first_places_every_piece():
    rng = np.random.default_rng(0)
    for _ in range(20):
        lengths = rng.integers(1, 65, rng.integers(1, 400))
        histogram = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
        placed: dict[int, int] = {}
        for packs, pattern in packing.shortest_pack_first(histogram, 64):
            assert sum(a * b for a, b in pattern) <= 64
            for length, copies in pattern:
                placed[length] = placed.get(length, 0) + packs * copies
        assert placed == histogram
    assert packing.shortest_pack_first({}, 64) == []


def check_packing(rows, tokens, capacity):
    """Pieces hold each document's ids once, and sequences are gapless."""
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for doc, own in by.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(tokens[doc])
            assert r.ids_crc32 == zlib.crc32(np.array(tokens[doc][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(tokens[doc])
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(sequences)


def test_packing_equals_the_tokenizer(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    odd = [None, "", " ", "It's don't l'été, NAÏVE! naïve!! (word) 3.14 a1b2 <|endoftext|> x<|startoftext|>", "Ünï cödé ÿ ß ẞ é ﬁ", "漢字 😀 Ω ΑΣ", "a b c", "many,,;;:: ...", "\x1c \x85 z", "w" * 3000 + " end", "word " * 9000]
    docs = spark.createDataFrame([(i, t, -1) for i, t in enumerate(odd)], "doc_id long, text string, length int")
    own = Tokenizer.from_file(path)
    tokens = {i: own.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(odd)}
    rows = packing.pack_documents(docs, path).collect()
    assert check_packing(rows, tokens, 4096) <= sum(map(len, tokens.values())) // 4096 + 2
    assert {r.doc_id for r in rows} == set(tokens)
    assert packing.pack_documents(docs.limit(0), path).count() == 0
    small = packing.pack_documents(docs, path, capacity=16).collect()
    check_packing(small, tokens, 16)


def test_packing_of_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    rows = packing.pack_documents(docs, queries.tokenizer_path()).collect()
    assert len(rows) == 3 and sorted(r.offset for r in rows) == [0, 3, 6] and len({r.sequence_id for r in rows}) == 1


def test_packing_padding_is_small(spark):
    rows = queries.op6_packing(spark, f"{DATA}/sf0.01").collect()
    total, sequences = sum(r.length for r in rows), len({r.sequence_id for r in rows})
    assert total / (sequences * 4096) > 0.98


# --- top-k --------------------------------------------------------------------------------------


def brute(rows, k):
    whole = {i: [int(np.floor(256 * float(x))) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = set()
    for q, a in whole.items():
        if q % 5:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in whole.items() if i != q)
        out |= {(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)}
    return out


@pytest.mark.parametrize("query_bytes", [8 << 20, 64])
def test_top_k_is_exact(spark, query_bytes):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=6).round(1)]) for i in range(700)]
    rows += [(1000 + i, [0.5] * 6) for i in range(300)] + [(5000, None), (5005, [1.0, None]), (5010, [float("nan")] * 6), (5015, [float("inf")] * 6), (5020, []), (5025, [1.0]), (None, [9.0] * 6), (5030, [1e9] * 6), (5035, [-3e12] * 6)]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, score int, rank string").repartition(3)
    found = topk.top_k(frame, F.col("vec_id") % 5 == 0, 5, query_bytes=query_bytes)
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect()} == brute(rows, 5)


def test_top_k_with_few_rows(spark):
    frame = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id, r.score) for r in topk.top_k(frame, F.col("vec_id") == 0).collect()] == [(0, 1, 131072)]
    assert topk.top_k(frame.limit(0), F.col("vec_id") == 0).count() == 0


# --- HTML ---------------------------------------------------------------------------------------


def page(body, title="T"):
    return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    "body, text",
    [
        ("<nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p>one\n two<br>three</p><p>x<b>y</b>z</article><footer>f</footer>", "A & B\none two three\nxyz"),
        ("<article><p><b>open<br><p>next<div class='ad'>buy</div><aside>side</aside><form>f<input></form></article>", "open\nnext"),
        ("<main><header>skip?</header><p>kept</p></main><div id=comments><article><p>long reader comment, longer than all</p></article></div>", "skip?\nkept"),
        ("<article><p>a</p><section class='comments'><p>c</p></section><ul><li>1<li>2</ul><table><tr><td>x<td>y</table></article>", "a\n1\n2\nx y"),
        ("<article><p>cut off <b>here &am", "cut off here &am"),
        ("<p>just text</p><p><a href=q>menu link</a></p>", "just text"),
        ("", ""),
        ("<article></article>", ""),
        ("<article><p>&nbsp;a&nbsp;&nbsp;b &lt;i&gt; &#233;</p><noscript>n</noscript><template><p>t</p></template></article>", "a b <i> é"),
    ],
)
def test_extraction(body, text):
    assert html_extract.extract_group([page(body)]) == [text]


def test_wrapper_is_induced_without_names():
    """Div soup: text that is the same on all pages of the host goes, varying text stays."""
    pages = [page(f"<div><div>Our site since 1999</div><div><div>story {i} about things</div><div>more of {i * 7}</div></div><div>All rights here</div></div>") for i in range(6)]
    assert html_extract.extract_group(pages) == [f"story {i} about things\nmore of {i * 7}" for i in range(6)]
    few = html_extract.extract_group(pages[:2])
    assert "Our site" in few[0]  # too few witnesses


def test_tree_matching_counts_pairs():
    a, b = html_extract.parse("<div><p>1<p>2<ul><li>x</ul></div>"), html_extract.parse("<div><p>1<ul><li>x<li>y</ul><p>3</div>")
    shapes = {}
    html_extract._measure(a, shapes)
    html_extract._measure(b, shapes)
    assert html_extract.match(a, b, {}) == 5
    assert len(html_extract.alignment(a, b)) == 5


def test_extraction_query(spark):
    rows = queries.op4_html_extract(spark, f"{DATA}/sf0.01").collect()
    source = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/sf0.01/pages.parquet").collect()}
    assert len(rows) == len(source)
    for r in rows:
        assert r.n_chars == len(r.text)
        inside = source[r.page_id].split("<article>")[1].split("</article>")[0]
        assert r.text.split("\n")[-1][:20] in __import__("html").unescape(inside) and "©" not in r.text


def test_extraction_edges(spark):
    rows = [(1, None, None), (2, "http://h/a", ""), (2, "http://h/a", ""), (3, "http://h/b", "<p>x"), (None, "//h/c", "<<<>>> < a"), (4, "http://h/d", "<p>" + "long " * 20000)]
    frame = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, part int")
    found = html_extract.extract_main_text(frame, group_pages=2).collect()
    assert len(found) == len(rows) and {r.page_id: r.text for r in found}[3] == "x"
    assert {r.page_id: r.n_chars for r in found}[4] == 5 * 20000 - 1
    assert html_extract.extract_main_text(frame.limit(0)).count() == 0


# --- models -------------------------------------------------------------------------------------


def test_gru_gradients_are_those_of_differences():
    net = language_id.BiGru(["a", "b", "c"], units=3, seed=1)
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 257, (5, 4))
    labels = np.array([0, 1, 2, 1])
    for name in ("tables", "recurrent", "out"):
        setattr(net, name, [x.astype(np.float64) for x in getattr(net, name)])
    net.bias = net.bias.astype(np.float64)
    _, grads = net.gradients(codes, labels)
    for p, g in zip(net.parameters(), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        before, eps = p[at], 1e-3
        p[at] = before + eps
        up = net.gradients(codes, labels)[0]
        p[at] = before - eps
        down = net.gradients(codes, labels)[0]
        p[at] = before
        assert (up - down) / (2 * eps) == pytest.approx(g[at], rel=2e-2, abs=1e-4)


def test_language_id(spark):
    rows = queries.op7_language_id(spark, f"{DATA}/sf0.01").collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_id_edges(spark):
    rows = [(i, "the cat " * 20, "en") for i in range(12)] + [(i + 20, "le chat été " * 20, "fr") for i in range(12)]
    rows += [(50, None, "en"), (51, "", None), (52, "123 !?", "fr"), (None, "the cat", "en"), (53, "x " * 50000, None), (54, "漢字", None)]
    frame = spark.createDataFrame([(*r, "q", 0.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    got = {r.doc_id: r for r in language_id.identify_languages(frame, queries.fold(5) == 0, steps=40).collect()}
    assert len(got) == len(rows) and got[50].lang_pred == got[51].lang_pred == got[52].lang_pred == "und"
    assert got[1].lang_pred == "en" and got[21].lang_pred == "fr" and got[54].lang_pred in ("en", "fr")
    assert language_id.identify_languages(frame.limit(0), queries.fold(5) == 0).count() == 0
    none = frame.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.identify_languages(none, queries.fold(5) == 0).collect()} == {"und"}


def test_factorization_machine_learns_a_pair():
    """Label 1 only where two terms meet: an additive model cannot tell."""
    rng = np.random.default_rng(0)
    terms, labels = [], []
    for _ in range(1500):
        a, b = rng.random(2) < 0.5
        terms.append(np.array([t for t, on in ((11, a), (22, b)) if on] + [int(rng.integers(100, 140))], np.int32))
        labels.append(int(a == b))  # exclusive: no linear rule
    terms = [np.unique(np.append(t, 33)) if y else t for t, y in zip(terms, labels, strict=True)] if False else terms
    old = toxicity.SCREEN
    toxicity.SCREEN = -1.0
    try:
        net = toxicity.fit(terms, np.array(labels))
    finally:
        toxicity.SCREEN = old
    logits = np.array([net.logits(np.zeros(len(t), int), net.slot[t].astype(int), 1)[0] for t in terms])
    assert ((logits > 0) == np.array(labels)).mean() > 0.9


def test_toxicity(spark):
    rows = queries.op9_toxicity(spark, f"{DATA}/sf0.1").collect()
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/sf0.1/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in label]
    toxic = [r for r in held if label[r.doc_id]]
    assert len(rows) == 10000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert sum(r.predicted for r in toxic) / len(toxic) > 0.8
    assert sum(r.predicted for r in held if not label[r.doc_id]) / (len(held) - len(toxic)) < 0.02


def test_toxicity_edges(spark):
    rows = [(i, "you idiot there" if i % 2 else "nice day there") for i in range(60)] + [(100, None), (101, ""), (None, "you idiot"), (102, "w " * 60000), (1, "you idiot there")]
    frame = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(7, None), (None, 1), (3, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(frame, labels, queries.fold(4) == 2).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].predicted == 1 and by[2].predicted == 0 and by[None].predicted == 1 and by[100].score == by[101].score and not by[None].held_out
    assert toxicity.toxicity(frame.limit(0), labels, queries.fold(4) == 2).count() == 0
    assert len({r.score for r in toxicity.toxicity(frame, labels.limit(0), queries.fold(4) == 2).collect()}) == 1
    left = toxicity.drop_toxic(frame, labels, queries.fold(4) == 2)
    assert left.columns == frame.columns and left.where("text like '%idiot%'").count() == 0 and left.where("text like '%nice%'").count() == 30
