"""The training-data operators against brute force, round trips, a reference library or held-out accuracy."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from math import log10
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from verdanta.llm import bpe, components, decontam, exact_dedup, html_extract, line_dedup, lm, ngram_join, pii, toxicity, url_filter
from verdanta.llm.textbatch import shingles, word_hashes

rng = random.Random(13)
VOCAB = ["".join(rng.choice("abcdefgäß") for _ in range(rng.randint(1, 7))) for _ in range(300)]
LONG = " ".join(rng.choice(VOCAB) for _ in range(30_000))
ODD = [None, "", " \t\n", "One", "a\x0bb", "ÀÉ ß", "x" * 5000, LONG, "same text here", "same text here", "Same  text\there"]
SCHEMA = "doc_id long, text string"


def sentence(n: int = 30) -> str:
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def frame(spark, rows):
    """Documents with columns whose names could clash with an operator's own."""
    df = spark.createDataFrame(rows, SCHEMA)
    extra = ["_text", "_id", "KEY", "n", "sid", "tok", "_words", "score", "n_lines", "item_ids", "row_key", "_in", "_at"]
    return df.select("*", *[F.lit("x").alias(c) for c in extra])


def empty(spark):
    return frame(spark, [])


def changed(text: str, n: int) -> str:
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(VOCAB) + "q"
    return " ".join(w)


def test_textbatch_words_and_shingles():
    texts = ["A b\tC", "", "d", " e f g h i "]
    raw = [t.encode() for t in texts]
    hashes, starts, ends, bounds = word_hashes(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    assert np.diff(bounds).tolist() == [3, 0, 1, 5]
    values, at = shingles(hashes, bounds, 4)
    assert np.diff(at).tolist() == [1, 0, 1, 2]


# --- 1


def test_pii(spark):
    card = "4111 1111 1111 1111"
    rows = [(1, f"mail jo.doe7@ex.org, card {card}, born 31.12.1999 or 1999-12-31"), (2, f"again {card}, ip 10.0.0.255, tel +1 (017) 555-7713, 123-45-6789, GB82 WEST 1234 5698 7654 32"), (3, "wrong 4111111111111112, 300.1.1.1, 31.02.2001, 000-12-3456, v1.2.3.4.5"), *[(10 + i, t) for i, t in enumerate(ODD)]]
    got = {r.doc_id: r for r in pii.pseudonymise(frame(spark, rows)).collect()}
    assert got[1].kinds == "card,date,email" and got[1].n_values == 4 and got[2].kinds == "card,iban,ip,phone,ssn"
    assert got[3].text == rows[2][1] and got[3].n_values == 0
    cards = [re.search(r"\d{4} \d{4} \d{4} \d{4}", got[i].text)[0] for i in (1, 2)]
    assert cards[0] == cards[1] != card and pii.luhn(cards[0].replace(" ", "")[:-1]) == int(cards[0][-1])
    d, iso = re.search(r"(\d\d)\.(\d\d)\.(\d{4})", got[1].text), re.search(r"\d{4}-\d\d-\d\d", got[1].text)[0]
    assert f"{d[3]}-{d[2]}-{d[1]}" == iso != "1999-12-31"
    assert [got[10 + i].text for i in range(len(ODD))] == ODD
    span = got[1].spans[1]
    assert rows[0][1][span.start : span.end] == card
    assert pii.pseudonymise(empty(spark)).count() == 0


def test_pii_permutations():
    f = pii.Feistel(b"k")
    assert sorted(f.permute("x", i, 1000) for i in range(1000)) == list(range(1000))
    assert all(f.permute("x", f.permute("x", i, 777), 777, back=True) == i for i in range(777))
    texts = {f"{a}{b}" for a in range(10) for b in "abc"}
    assert len({f.characters("t", t) for t in texts}) == len(texts) and f.characters("t", f.characters("t", "Ab-9"), back=True) == "Ab-9"
    for n in (1, 63, 64, 65, 129):
        own = "".join(rng.choice("abcXYZ019") for _ in range(n))
        assert f.characters("t", f.characters("t", own), back=True) == own
    p = pii.Pseudonyms(b"k")
    ssn = {p("ssn", f"{a:03d}-{g:02d}-0001") for a in (1, 665, 667, 899) for g in (1, 50, 99)}
    assert len(ssn) == 12 and all(0 < int(s[:3]) < 900 and s[:3] != "666" for s in ssn)


@pytest.mark.parametrize("n", [1, 7, 60, 250, 5000])
def test_pii_round_trip(n):
    there, back = pii.Pseudonyms(b"k"), pii.Pseudonyms(b"k", back=True)
    name = ".".join("".join(rng.choice("abcdefXYZ0189") for _ in range(min(n, 30 * n // 4))) for _ in range(1 + n // 100))[: n + 20].strip(".")
    values = [f"{name}@mail.example.org", f"{name}@{'sub.' * 40}org", "GB82 WEST 1234 5698 7654 32", "4111-1111-1111-1111", "378282246310005", "123-45-6789", "10.20.30.40", "+49 (030) 555-1234", "555-123-4567", "2001-02-28", "01/12/1999", "31.12.2049"]
    rng.shuffle(values)
    text = "; ".join(values)
    new, spans = there.replace(text)
    assert len(spans) == len(values) and not any(v in new for v in values)
    assert back.replace(new)[0] == text and there.replace(text)[0] == new
    assert [len(x) for x in new.split("; ") if x.count(".") != 3] == [len(x) for x in values if x.count(".") != 3]  # octets vary in length


def test_pii_side_by_side():
    p = pii.Pseudonyms(b"k")
    kinds = lambda t: [k for _, _, k in p.replace(t)[1]]
    assert kinds("2021-03-04 123-45-6789") == ["date", "ssn"] and kinds("2020-01-02 555-123-4567") == ["date", "phone"]
    assert kinds("GB82 WEST 1234 5698 7654 32 12 X") == ["iban"] and kinds("GB82 WEST 1234 5698 7654 33") == []
    for hard in ("%" * 100_000, "1 " * 50_000, "a.b" * 50_000, "1-" * 50_000, "x@" * 50_000):
        p.replace(hard)  # in time in proportion to the length


# --- 2


def test_bpe_like_the_library(spark):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    odd = [t or "" for t in ODD] + ["it's we're 'she \"'s ''s I'll 'l", "a<|endoftext|>b <|STARTOFTEXT|> x<|startoftext|>", "İ ΣΑΣ ς Ⅷ½ 12345 \x1c\x85 áé 漢字 🎉🎉!!!", "!" * 3000, "aaaa" * 999, "​\ufeff Ω\u0301"]
    odd += ["".join(rng.choice("aAeé' s<|>0½!\n漢'tdrevl") for _ in range(60)) for _ in range(200)]
    got = {r.doc_id: r for r in bpe.encode(frame(spark, list(enumerate(odd))), path, ids=True).collect()}
    for i, e in enumerate(library.encode_batch(odd, add_special_tokens=False)):
        assert got[i].ids == e.ids, odd[i][:50]
        plain = library.decode(e.ids, skip_special_tokens=False)
        assert got[i].decoded == plain and got[i].decoded_sha256 == hashlib.sha256(plain.encode()).hexdigest() and got[i].n_tokens == len(e.ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest()
    assert bpe.encode(frame(spark, [(None, None)]), path).first().n_tokens == 0 and bpe.encode(empty(spark), path).count() == 0


# --- 3


def test_decontamination(spark):
    items = [(i, sentence(rng.randint(3, 60))) for i in range(30)] + [(90, None), (91, "  "), (92, "!!"), (None, sentence(20)), (7, sentence(25))]
    rows = [(i, sentence(20) + " " + (changed(q, rng.randint(0, 2)) if q and len(q.split()) > 9 else q or "") + ", " + sentence(rng.randint(0, 900))) for i, (_, q) in enumerate(items)]
    rows += [(100, items[4][1].upper().replace(" ", " -- ")), (101, LONG + " " + items[5][1] + " " + LONG)] + [(200 + i, t) for i, t in enumerate(ODD)]
    b = spark.createDataFrame(items, "item_id long, text string")
    for words in (decontam.BLOCK_WORDS, 200):
        got = {r.doc_id: r for r in decontam.search(frame(spark, rows), b, block_words=words).collect()}
        assert len(got) == len(rows)
        for d, t in rows:
            want = brute.contaminated(t, items)
            assert got[d].item_ids == sorted(k for k in want if k is not None), d
            assert got[d].contaminated == bool(want) and got[d].max_containment == pytest.approx(max(want.values(), default=0)) and got[d].text == t
    assert decontam.search(empty(spark), b).count() == 0 and decontam.search(frame(spark, rows), b.limit(0)).where("contaminated").count() == 0


# --- 4


def test_toxicity(spark):
    bad = ["grumblefish", "snottwaddle", "vilecreep"]
    rows = [(i, sentence(40) + (f" {rng.choice(bad)} " + sentence(5)) * 2 * (i % 4 == 0)) for i in range(1500)]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(1200)] + [(0, 1, 0), (None, 0, 1), (5, None, None)]
    unseen = [(5000 + i, sentence(40) + " grumbelfish grumblefissh vilecreeps " * 2 + sentence(8)) for i in range(40)]
    docs = frame(spark, rows + unseen + [(9000 + i, t) for i, t in enumerate(ODD)])
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.judge(docs, lab).collect()}
    assert len(got) == len(rows) + len(unseen) + len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    held = [d for d, _ in rows if d < 1200 and got[d].held_out]
    assert np.mean([got[d].predicted == (d % 4 == 0) for d in held]) > 0.95
    assert np.mean([got[d].predicted for d, _ in unseen]) > 0.8
    assert got[9008].score == got[9009].score
    assert toxicity.judge(empty(spark), lab).count() == 0
    none = toxicity.judge(docs, lab.where("toxic = 0")).agg(F.max("score"), F.min("score")).first()
    assert none[0] == none[1] < 0.1


def test_toxicity_scores_by_brute_force(spark):
    bits, r = 10, np.random.default_rng(3)
    folded, bias = r.standard_normal(1 << bits).astype(np.float32), -0.3
    texts = [sentence(k) for k in (1, 3, 50, 400)] + ["Stoß, ΣΑΣ!", "", None, LONG, "one one two"]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    clean = {x.doc_id: x.w.split() for x in docs.select("doc_id", toxicity.words_of(F.col("text")).alias("w")).collect()}

    def word(w: str) -> float:
        buckets, sizes = toxicity.word_buckets([w], bits)
        grams = {(n, i) for n in (3, 4, 5) for i in range(len(w) + 3 - n)}
        assert sizes[0] == len(buckets) == 1 + len(grams)
        return float(folded[buckets].mean())

    for x in toxicity.score(docs, (folded, bias)).collect():
        own = clean[x.doc_id]
        logit = bias + sum(map(word, own)) / (len(own) + toxicity.PRIOR_WORDS)
        assert x.score == pytest.approx(1 / (1 + np.exp(-logit)), rel=1e-6)


def test_toxicity_learns_whole_texts_once_an_id(spark):
    docs = spark.createDataFrame([(i, "word " * 30 + ("vile " if i % 2 else "kind ") * 6 + ("filler " * 8000 if i < 40 else "")) for i in range(300)] + [(1, "other")] * 200, SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.judge(docs, labels).where("doc_id >= 40").collect()}
    assert np.mean([got[i] == i % 2 for i in range(40, 300)]) > 0.97


@pytest.mark.parametrize("n_toxic", [10, 20, 50])
def test_toxicity_of_rare_insults(n_toxic):
    r = random.Random(n_toxic)
    clean = lambda: " ".join(r.choice(VOCAB) for _ in range(40))
    insults = ["".join(r.choice("hijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(n_toxic // 5)]
    texts = [f"{clean()} {insults[i % len(insults)]} {clean()}" for i in range(n_toxic)] + [f"{clean()} {clean()}" for _ in range(200)]
    values, _ = toxicity.train([tuple(zip(*Counter(t.split()).items())) for t in texts], np.arange(len(texts)) < n_toxic, n_toxic / len(texts))
    known = toxicity.WordValues(values.astype(np.float64))

    def value(words: list[str]) -> np.ndarray:
        raw = " ".join(words).encode()
        hashes, starts, ends, _ = toxicity.chunk_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        return known(np.frombuffer(raw, np.uint8), hashes, starts, ends)

    assert all((values[toxicity.word_buckets([w])[0]] != 0).all() for w in insults)
    assert value(insults).min() > np.quantile(value(VOCAB), 0.95)


# --- 5

PAGE = "<html><head><title>no</title><script>var x='<p>no</p>';</script></head><body><header>{site} head</header><nav><a>menu</a></nav><div class='box'>{site} says: buy</div><{tag}><h1>T{i}</h1><p>First  &amp; {body}<br>more <b>bold</b>er<p>Second &lt;{i}&gt;<form>form</form>{lines}</{tag}><div id='comments-list'><p>reader {i}</p></div><aside>side</aside><div class=cookie-notice>c</div><footer>f</footer></body>"


def test_html(spark):
    rows = []
    for i in range(60):
        tag = "article" if i % 2 else "div"
        body = f"{sentence(6)}"
        rows.append((i, f"http://{'a' if i < 40 else 'b'}.org/x{i}", PAGE.format(site="Shop", tag=tag, i=i, body=body, lines="".join(f"<p>line {i} {k}" for k in range(i % 5))), f"T{i} First & {body} more bolder Second <{i}>" + "".join(f" line {i} {k}" for k in range(i % 5))))
    odd = [(100, None, None, ""), (101, "", "", ""), (102, "no scheme", "plain &eacute; text", "plain é text"), (103, "http://c.org", "<p>cut <b>off", "cut off"), (104, "http://c.org", "<div>" * 3000 + "deep", "deep"), (105, "http://c.org", "<p>" + LONG, LONG), (105, "http://c.org", "<p>" + LONG, LONG)]
    df = spark.createDataFrame([r[:3] for r in rows + odd], "page_id long, url string, html string").withColumns({"host": F.lit("x"), "low": F.lit(1), "text": F.lit("t")})
    got = html_extract.extract(df).collect()
    assert len(got) == len(rows) + len(odd)
    want = {r[0]: r[3] for r in rows + odd}
    assert [(r.page_id, r.text, want[r.page_id]) for r in got if r.text != want[r.page_id]] == []
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_extract.extract(df.limit(0)).count() == 0


def test_style_tree_by_brute_force(spark):
    pages = [(i, f"http://{'ab'[i % 2]}.org/{i}", PAGE.format(site="Shop", tag="div", i=i % 7, body=sentence(4), lines="".join(f"<p>line {k}. {i}" for k in range(i % 4)))) for i in range(30)]
    pages += [(100, None, "<div><img src=x><a href=y>go</a></div>"), (101, "http://a.org", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    hosts, every = html_extract.style_tree(df)
    key = {r.url: r.h for r in df.select("url", F.xxhash64(html_extract.host_of(F.col("url"))).alias("h")).collect()}
    for by, got in ((lambda h: h, hosts.collect()), (lambda h: 0, every.collect())):
        want = brute.style_tree([(by(key[u]), html) for _, u, html in pages])
        assert len(got) == len(want)
        for r in got:
            m, content, shape, value = want[(by(getattr(r, "host", 0)), r.node)]
            assert r.m == m and r.importance == pytest.approx(value) and r.content_importance == (content if content is None else pytest.approx(content))
            assert r.shape_importance == (shape if shape is None else pytest.approx(shape))


def _plain(html: str) -> str:
    """The page with neutral names: no class, id or role, and every block a div."""
    html = re.sub(r" (?:class|id|role)=(?:'[^']*'|\S+?(?=[ >]))", "", html)
    return re.sub(r"<(/?)(?:header|nav|aside|article|main|footer|form)\b", r"<\1div", html)


def test_html_by_the_style_tree_alone(spark):
    """Names in the markup gone, what a site's pages repeat still goes and the articles stay."""
    offers, rows = [sentence(7) for _ in range(9)], []
    for i in range(1500):
        title, body = sentence(5), [sentence(rng.randint(5, 30)) for _ in range(rng.randint(1, 6))]
        html = f"<html><head><title>{title}</title></head><body><nav><ul>{''.join(f'<li><a href=/{k}>{w}</a></li>' for k, w in enumerate(VOCAB[i % 9 : i % 9 + 5]))}</ul></nav><div class='ad'>{offers[i % 9]}</div><article><h1>{title}</h1>{''.join(f'<p>{x}</p>' for x in body)}</article><footer>&copy; {offers[i % 7]}</footer></body></html>"
        rows.append((i, f"http://h{i % 40 if i % 3 else 0}.org/{i}", html, " ".join([title, *body])))
    want = {r[0]: r[3] for r in rows}
    for plain in (False, True):
        df = spark.createDataFrame([(i, u, _plain(h) if plain else h) for i, u, h, _ in rows], "page_id long, url string, html string").repartition(6)
        assert {r.page_id: r.text for r in html_extract.extract(df).collect()} == want
        all_of_it = {r.page_id: r.text for r in html_extract.extract(df, low=-1).collect()}
        assert all(all_of_it[i] != want[i] for i in want)


def test_composite_importance_by_brute_force(spark):
    """Content entropy at the leaves, presentation entropy and the mean of the layouts up the branch."""
    pages = []
    for i in range(120):
        extra = "<div><img src=x><span>lead. {0}</span><p>own {0}</p><hr></div>".format(i % 3) if i % 4 else ""
        items = "".join(f"<li>{VOCAB[(i + k) % 5]}</li>" for k in range(3 + i % 2))
        mixed = f"<section>note {i % 6}. same<p>in {i}</p>{'<p>more</p>' * (i % 3 == 0)}</section>" if i % 5 else "<section>alone</section>"
        pages.append((i, f"http://{'ab'[i % 2]}.org/{i}", f"<body><div><ul>{items}</ul></div>{extra}<div></div>{mixed}<main>{'<p>line' * (i % 9)}</main></body>"))
    pages += [(200, None, "<div>x</div>"), (201, "http://a.org", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    key = {r.url: r.h for r in df.select("url", F.xxhash64(html_extract.host_of(F.col("url"))).alias("h")).collect()}
    want = brute.composites([(key[u], html) for _, u, html in pages], html_extract.MIN_PAGES)
    by_host: dict[int, list] = {}
    for r in html_extract.trees(df)[2].collect():
        by_host.setdefault(r.host, []).append(r.asDict())
    got = {(host, x["style"]): (x, value[x["style"]]) for host, rows in by_host.items() for value in [html_extract.composites(rows)] for x in rows}
    assert got.keys() == want.keys() and len(got) > 40
    for at, (x, value) in got.items():
        m, content, shape, composite = want[at]
        assert x["m"] == m and value == pytest.approx(composite)
        assert x["content_importance"] == (content if content is None else pytest.approx(content))
        assert x["own_shape"] == (shape if shape is None else pytest.approx(shape))


def test_html_by_layout(spark):
    """A site's two layouts have the advert where the other has the article, and the article where the other has the footer."""
    offers, rows = [sentence(7) for _ in range(9)], []
    for i in range(1600):
        body, menu = " ".join(sentence(20) + f" {i}." for _ in range(3)), "".join(f"<li><a href=/{k}>{w}</a></li>" for k, w in enumerate(VOCAB[:5]))
        advert = f"<div>{offers[i % 9]}</div>" if i % 2 else ""
        rows.append((i, f"http://h.org/{i}", f"<body><div><ul>{menu}</ul></div>{advert}<div>{body}</div><div>{offers[i % 7]}</div></body>", body))
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r for r in html_extract.extract(df).collect()}
    assert [(i, got[i].text) for i, _, _, body in rows if got[i].text != body] == []
    # the menu, the footer and on every second page the advert, each removed as one branch
    assert all(got[i].n_noise == 2 + i % 2 for i in got)


def test_html_names_as_a_prior(spark):
    cases = [
        ("<html><head><title>no</title><body><p>head not closed</p></body>", "head not closed"),
        ("<div class='site has-sidebar'><p>wrapped</p><div class='sidebar'>side</div></div>", "wrapped"),
        ("<article class='post no-comments'><p>kept</p></article><section class='comments'><article>said</article></section>", "kept"),
        ("<div class='search-page'><main><p>inner</p></main><form>f</form></div>", "inner"),
        ("<article><header><h1>Title</h1></header><p>x</p><aside>a</aside></article><header>page</header>", "Title x"),
        ("<p>one<p>two<script>var a</script><style>b</style><template>t</template>", "one two"),
    ]
    df = spark.createDataFrame([(i, "http://a.org", h) for i, (h, _) in enumerate(cases)], "page_id long, url string, html string")
    assert [r.text for r in html_extract.extract(df).orderBy("page_id").collect()] == [t for _, t in cases]


def test_html_deep_page_takes_little_memory():
    import tracemalloc

    page = html_extract.Page()
    tracemalloc.start()
    assert page.read("<div>" * 40_000 + "deep" + "</div>" * 40_000).article({}, {}) == "deep" and len(page.observed()) == 80_001
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6


# --- 6


def test_lm(spark):
    rows = [(i, sentence(60) + (" Rare%d" % i)) for i in range(80)] + [(500 + i, t) for i, t in enumerate(ODD)]
    got = {r.doc_id: r for r in lm.score(frame(spark, rows)).collect()}
    train = Counter()
    for d, t in rows:
        if zlib.crc32(str(d).encode()) % 10:
            train.update([*brute.words(t), None])
    n, v = sum(train.values()), len(train)
    for d, t in rows:
        w = [*brute.words(t), None]
        assert got[d].n_tokens == len(w) and got[d].n_known == sum(train[x] > 0 for x in w) and got[d].train_tokens == n and got[d].held_out == (zlib.crc32(str(d).encode()) % 10 == 0)
        assert got[d].base_score == pytest.approx(sum(log10((train[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        assert got[d].score < 0
    none = lm.score(frame(spark, [(i, "a b") for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0])).first()
    assert none.train_tokens == 0 and none.n_known == 0
    assert lm.score(empty(spark)).count() == 0


def test_lm_is_normalised_and_learns():
    r = np.random.default_rng(1)
    table = np.zeros((lm.M, lm.M))
    table[:50, :50] = np.eye(50)[r.permutation(50)] * 200 + 1
    cells = np.flatnonzero(table)
    out = lm.train(cells, table.ravel()[cells], steps=800).astype(np.float64)
    assert np.allclose(np.exp(out).sum(1), 1, atol=1e-4)
    share = table / table.sum()
    unigram = np.log((table.sum(0) + 0.1) / (table.sum() + 0.1 * lm.M))
    assert (share * out).sum() > (share * unigram[None, :]).sum() + 0.5


# --- 7


def test_line_dedup(spark):
    base = [sentence(rng.randint(1, 14)) for _ in range(60)]

    def edited(t: str) -> str:
        i = rng.randrange(len(t))
        return rng.choice([t[:i] + t[i + 1 :], t[:i] + "z" + t[i:], t[:i] + "z" + t[i + 1 :], t, t.upper(), f"  {t}\t", t[:i] + "zz" + t[i:]])

    rows = [(i, "\n".join(edited(rng.choice(base)) for _ in range(rng.randint(1, 6)))) for i in range(120)]
    rows += [(1000 + i, t) for i, t in enumerate(ODD)] + [(2000, LONG[:3000]), (2001, LONG[:1500] + "#" + LONG[1501:3000]), (2002, LONG[:2999]), (None, base[0] + "\nonly here, this line")]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    for d, text, n, k in brute.dedup_lines(rows):
        assert (got[d].text, got[d].n_lines, got[d].n_dropped) == (text, n, k), d
    twice = line_dedup.dedup_lines(frame(spark, [(1, "a line of some length"), (1, "a line of some length"), (2, "a line of some length")])).collect()
    assert sorted((r.doc_id, r.text) for r in twice) == [(1, "a line of some length"), (1, "a line of some length"), (2, "")]
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


# --- 8


def test_globs():
    globs = ["net/**", "*.net/**", "a*c", "**x**", "", "*", "exact/path", "ab" * 70 + "*"]
    texts = [b"net/", b"a.net/q/r", b"x/a.net/q", b"abc", b"a/c", b"", b"axb/", b"exact/path", b"ab" * 70 + b"tail", b"n", b"\xff\xfe"]
    rx = [re.compile(b"".join(b".*" if p == "**" else b"[^/]*" if p == "*" else re.escape(p.encode()) for p in re.findall(r"\*+|[^*]+", g)), re.S) for g in globs]
    got = url_filter.GlobSet(globs).match(texts)
    assert got.tolist() == [[bool(r.fullmatch(t)) for r in rx] for t in texts]


def test_url_filter(spark):
    urls = ["http://x.NET/en/a?b", "https://a.example.net/en/x#y", "http://example.com/de/", "http://q.org/fr/1", "http://q.org", "http://notexample.com/de/", "http://spam-farm.org/x", None, "", "no scheme", "a://b://c/d", "http://net", "http://x.net?q=/", "http://u.org/" + "p/" * 4000, "http://x.NET/en/a?b"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"host": F.lit(1), "rule": F.lit(2)})
    got = {r.page_id: (r.host, r.path[:20], r.rule, r.verdict) for r in url_filter.judge(df).collect()}
    assert [got[i] for i in range(6)] == [("x.net", "/en/a", "net/", "block"), ("a.example.net", "/en/x", "example.net/en/", "allow"), ("example.com", "/de/", "example.com/de/", "block"), ("q.org", "/fr/1", "org/fr/", "allow"), ("q.org", "", None, "allow"), ("notexample.com", "/de/", None, "allow")]
    assert got[6][3] == "block" and got[7] == got[8] == got[9] == ("", "", None, "allow") and got[10] == ("b:", "//c/d", None, "allow") and got[11] == got[11] and got[12] == ("x.net", "", None, "allow") and got[14] == got[0]
    assert url_filter.judge(df.limit(0)).count() == 0


# --- 9


def test_ngram_join(spark):
    rows: list[tuple] = []
    for _ in range(25):
        base = sentence(rng.choice([2, 5, 12, 40, 120, 400]))
        for _ in range(rng.randint(1, 6)):
            rows.append((len(rows), changed(base, rng.randint(0, max(1, len(base.split()) // 40)))))
    rows += [(1000 + i, t) for i, t in enumerate(ODD)] + [(5, rows[0][1]), (None, rows[1][1]), (None, "alone among the others here")]
    want = brute.components(rows)
    got = ngram_join.similar_components(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter((d, len(brute.shingles(t, 4)), c) for (d, t), c in zip(rows, want))
    kept = ngram_join.keep_one(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter((d, t) for (d, t), c in zip(rows, want) if d == c)
    assert ngram_join.similar_components(empty(spark)).count() == 0


def test_large_group_of_near_copies(spark):
    base = sentence(120)
    rows = [(i, changed(base, 1)) for i in range(700)]
    got = ngram_join.similar_components(frame(spark, rows), block=64).collect()
    want = brute.components(rows[:1] + rows[1:])
    assert [r.component_id for r in sorted(got, key=lambda r: r.doc_id)] == want


def test_document_contained_in_a_longer_one(spark):
    r, rows, percent = random.Random(85), [], 85
    for n in (5_000, 10_000, 20_000, 50_000, 100_000):
        long = [r.choice(VOCAB) for _ in range(n)]
        rows += [(len(rows), " ".join(long)), (len(rows) + 1, " ".join(long[: (10 * percent + 1) * n // 1000 + 4]))]
    got = ngram_join.similar_components(frame(spark, rows), percent=percent).collect()
    assert {x.doc_id: x.component_id for x in got} == {d: d - d % 2 for d, _ in rows}


def test_shared_shingles_of_linked_sets():
    r = np.random.default_rng(4)
    for percent in (80, 85):
        for n in (30, 300, 5_000, 20_000, 100_000):
            union, only = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64)), (100 - percent) * n // 100
            order = r.permutation(len(union))
            for left in (0, only // 2, only):  # shingles of the first set alone
                a, b = np.sort(union[order[only - left :]]), np.sort(union[order[: len(union) - left]])
                shared = len(np.intersect1d(a[: ngram_join.prefix_length(len(a), percent)], b[: ngram_join.prefix_length(len(b), percent)]))
                assert shared >= max(ngram_join.least_shared(len(x), len(x), percent) for x in (a, b))


def test_trie():
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 60, r.integers(1, 40)).astype(np.uint64)) for _ in range(80)]
    trie = ngram_join.SetTrie(sets)
    for q in sets:
        want = {i for i, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= 50 * len(np.union1d(q, s))}
        assert set(trie.similar(q, 50)) == want


def test_components(spark):
    links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    comp = {}
    for a, b in links:
        comp.setdefault(a, a), comp.setdefault(b, b)
    for _ in range(200):
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    used = {x for a, b in links if a != b for x in (a, b)}
    got = components.connected(spark.createDataFrame(links, "u long, v long")).collect()
    assert {(r.id, r.component) for r in got} == {(k, v) for k, v in comp.items() if k in used} and len(got) == len(used)


# --- 10


def test_exact_dedup(spark):
    rows = [(i, rng.choice(["a b", "a  b", "ab ", "c", "C", "a\tb\n"])) for i in range(60)] + [(100 + i, t) for i, t in enumerate(ODD)] + [(None, "a b   "), (7, "dup"), (7, "dup")]
    for bits in (27, 15, 8):  # the last: several ranges with a filter each
        got = exact_dedup.exact_duplicates(frame(spark, rows), filter_bits=bits).collect()
        groups: dict[str, list] = {}
        for d, t in rows:
            groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), d is None, d))
        want = Counter()
        for d, t in rows:
            key = re.sub(r"[\x20\x09-\x0D]", "", t or "")
            best = min(groups[key], key=lambda x: (x[0], x[1], x[2] or 0))
            want[(d, best[2], len(groups[key]), (-len(t or ""), d) == (best[0], best[2]), hashlib.sha256(key.encode()).hexdigest())] += 1
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want
    assert exact_dedup.exact_duplicates(empty(spark)).count() == 0


# --- pipeline


def test_pipeline(spark, tmp_path):
    tokenizers, public, pipeline = (pytest.importorskip(x) for x in ("tokenizers", "public_tokenizers", "corpus_pipeline"))
    bad = ["grumblefish", "snottwaddle", "vilecreep"]
    base = sentence(80)
    items = [(i, sentence(30)) for i in range(5)]
    rows = [(i, "\n".join(sentence(14) for _ in range(3)) + (f" {rng.choice(bad)} " * 6) * (i % 4 == 0)) for i in range(400)]
    rows += [(1000 + i, changed(base, 1)) for i in range(5)] + [(2000, sentence(30) + " " + items[2][1] + " " + sentence(30)), (2001, rows[1][1]), (2002, None), (2003, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "decontamination", "bpe"]
    toxic = {r.doc_id for r in toxicity.judge(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).where("predicted = 1").collect()}
    assert np.mean([(d in toxic) == (d % 4 == 0) for d in range(400)]) > 0.97
    left = [(d, t) for d, t in rows if d not in toxic]
    left = [(d, t) for d, t, _, _ in brute.dedup_lines(left)]
    left = [(d, t) for (d, t), c in zip(left, brute.components(left, 5, 80)) if d == c]
    left = [(d, t) for d, t in left if not brute.contaminated(t, items)]
    library = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    want = {d: hashlib.sha256(np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() for d, t in left}
    got = {r.doc_id: r.ids_sha256 for r in pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want and 2000 not in got and 2003 in got


def test_pipeline_with_clashing_and_without_rows(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    names = ["n_lines", "N_Dropped", "item_ids", "max_containment", "contaminated", "toxicity_score", "_key", "_row", "_found", "score"]
    docs = spark.createDataFrame([(i, sentence(20) + "\n" + sentence(20)) for i in range(30)] + [(None, None), (3, "")], SCHEMA).select("*", *[F.lit(f"own {n}").alias(n) for n in names])
    spark.createDataFrame([(i, 1, i % 2) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, sentence(9)), (1, sentence(9)), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (docs, docs.limit(0)):
        for name, stage in pipeline.STAGES[:-1]:
            out = stage(spark, rows, str(tmp_path))
            assert out.columns == docs.columns, name
            for r in out.collect():
                assert [r[n] for n in names] == [f"own {n}" for n in names], name
        assert pipeline.STAGES[-1][1](spark, rows, str(tmp_path)).count() == rows.count()


DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no test data here")
def test_queries_against_sql(spark):
    import duckdb

    from tests.test_queries import plain
    from verdanta.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES) == list(range(1, 11))
    for name, sql in ORACLES.items():
        got, want = QUERIES[name](spark, str(DATA)).toPandas(), con.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want), name
