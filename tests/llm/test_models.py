"""Trained operators: gradients, held-out accuracy on small tables, edge cases."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from admitflow.llm import html_extract, quality, samples, toxicity
from admitflow.llm import wordhash as wh
from tests.llm import corpus as C

SF = "/root/testdata/sf0.01"


def _bags(texts):
    data, offsets = wh.text_buffers(pa.array(texts))
    bag, first = quality.encode(data, offsets)
    return [bag.take(np.arange(i, j)) for i, j in zip(first[:-1], first[1:], strict=True)]


def _words(rng, n):
    return " ".join(rng.choice(["one", "Two", "three.", "fo-ur", "5ive", "é"]) for _ in range(n))


def test_attention_gradient():
    rng = random.Random(1)
    bags = _bags([_words(rng, n) for n in (3, 200, 100, 400)] + [""])
    y = np.array([0.0, 1.0, 1.0, 0.0, 1.0])
    model = quality.train(bags, y, epochs=1)
    model.p.update({k: v.astype(np.float64) for k, v in model.p.items()})
    whole, first = quality.Bag.joined(bags), np.cumsum([0, *map(len, bags)])

    def loss():
        s = model.forward(whole, first)["score"]
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    for name, g in model.gradient(whole, first, y).items():
        flat, i = model.p[name].reshape(-1), int(np.abs(g).argmax())
        old = flat[i]
        flat[i] = old + 1e-6
        up = loss()
        flat[i] = old - 1e-6
        down = loss()
        flat[i] = old
        assert abs((up - down) / 2e-6 - g.reshape(-1)[i]) < 1e-5


def test_bags_are_packed_and_taken():
    one, two = _bags(["a bc def " * 60, "x"])
    again = quality.Bag.unpack(one.pack())
    assert (again.x == one.x).all() and all((a == b).all() for a, b in zip(again.grams + again.ends, one.grams + one.ends, strict=True))
    both = quality.Bag.joined([one, two]).take(np.array([len(one)]))
    assert (both.x == two.x).all() and all((a == b).all() for a, b in zip(both.grams, two.grams, strict=True))
    assert len(two.grams[0]) == 1 and len(two.grams[1]) == 1 and len(two.grams[2]) == 0


def test_quality_reads_order_and_content():
    import duckdb

    texts = [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' JOIN '{SF}/labels.parquet' USING (doc_id) "
                                      "WHERE quality = 1 AND length(text) > 300 ORDER BY doc_id LIMIT 240").fetchall()]
    rng = random.Random(2)
    shuffled = lambda t: " ".join(rng.sample(t.split(), len(t.split())))
    replaced = lambda t: "".join(rng.choice("bcdfghjklmnpqrstvwxz") if "a" <= c <= "z" else c for c in t)
    for change in (shuffled, replaced):
        train = texts[:80] + [change(t) for t in texts[80:160]]
        model = quality.train(_bags(train), np.repeat([1.0, 0.0], 80))
        score = lambda x: model.score(quality.Bag.joined(x), np.cumsum([0, *map(len, x)]))
        held = texts[160:]
        assert np.mean(score(_bags(held)) > score(_bags([change(t) for t in held]))) > 0.9


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels, train_on=samples.fold(F.col("id"), 5) != 0)
    rows = quality.score_documents(docs, model).join(labels, "doc_id").filter(samples.fold(F.col("doc_id"), 5) == 0).collect()
    right = [(r["score"] >= 0.3) == (r["quality"] == 1) for r in rows]
    assert len(right) > 50 and np.mean(right) >= 0.95


def test_quality_edges(spark):
    rows = [(1, None), (2, ""), (None, "a b c"), (3, "x " * 5000), (3, "x " * 5000)]
    none = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int")
    for labels in (none, spark.createDataFrame([(1, 1), (1, 0), (2, 1)], "doc_id long, quality int")):
        model = quality.fit(C.docs(spark, rows), labels)
        got = quality.score_documents(C.docs(spark, rows), model)
        assert got.columns == [c for c in C.docs(spark, rows).columns if c != "score"] + ["score"]
        assert len(got.collect()) == 5 and all(0 <= r["score"] <= 1 for r in got.collect())
    assert quality.score_documents(C.docs(spark, []), model).count() == 0


def made_toxic(seed, n):
    rng = random.Random(seed)
    words = [a + b for a in ("al", "be", "co", "du", "em") for b in ("ra", "si", "to", "na", "vel", "mor")]
    bad = ["grux" + e for e in ("a", "eno", "ist", "or")] + ["vlok"]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(rng.randint(3, 6)):
                w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = made_toxic(1, 1500)
    docs, marks = C.docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    known = marks.filter(F.col("doc_id") % 2 == 0)  # labels as they occur, so their share is the prior
    model = toxicity.fit(docs, known, train_on=samples.fold(F.col("id"), 3) != 1)
    rows = toxicity.score_documents(docs, model).join(marks, "doc_id").filter(samples.fold(F.col("doc_id"), 3) == 1).collect()
    hit = [r["score"] >= 0.7 for r in rows if r["toxic"]]
    false = [r["score"] >= 0.7 for r in rows if not r["toxic"]]
    assert np.mean(hit) >= 0.9 and np.mean(false) <= 0.02


def test_toxicity_risk_keeps_the_prior():
    """Without a signal the scores stay near the prior, not at one or zero."""
    rng = np.random.default_rng(2)
    docs = [np.unique(rng.integers(0, 50, 10)) for _ in range(600)]
    w, b = toxicity.train_one(docs[:200], docs[200:], 50, 0.2, 1)
    score = np.array([1 / (1 + np.exp(-(w[d].sum() + b))) for d in docs[200:]])
    assert score.mean() < 0.7


def test_toxicity_edges(spark):
    rows = [(1, None), (2, ""), (None, "grux"), (3, "vlok " * 9), (3, "vlok " * 9)]
    for labels in ([(None, 1), (1, None)], [(3, 1), (2, 0)]):
        model = toxicity.fit(C.docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
        got = toxicity.score_documents(C.docs(spark, rows), model).collect()
        assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score_documents(C.docs(spark, []), model).count() == 0


def article(rng, tag, attrs, paragraphs):
    return f"<{tag}{attrs}><h1>Title &amp; more</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs) + f"</{tag}>"


def made_page(seed):
    rng = random.Random(seed)
    words = "sun rain wind cloud river stone field house road bridge tree leaf".split()
    text = lambda k: " ".join(rng.choice(words) for _ in range(k)).capitalize() + "."
    paragraphs = [text(rng.randint(15, 60)) for _ in range(rng.randint(2, 6))]
    page = (f"<html><head><title>T</title><style>p{{}}</style></head><body><header class='site-header'><p>{text(3)}</p></header>"
            f"<nav><ul><li><a href='/'>{text(1)}</a></li><li><a href='/x'>{text(2)}</a></li></ul></nav>"
            f"<div class='cookie-notice'><p>{text(8)}</p></div>"
            + article(rng, "article", "", paragraphs)
            + f"<aside class='sidebar'><h3>{text(2)}</h3><p>{text(12)}</p></aside>"
            f"<section id='comments'><h3>{text(2)}</h3><div class='comment'><p>{text(20)}</p></div><div class='comment'><p>{text(9)}</p></div></section>"
            f"<form class='newsletter'><p>{text(6)}</p></form><script>var a='<p>no</p>';</script><footer>&copy; {text(4)}</footer></body></html>")
    return page, "\n".join(["Title & more", *paragraphs])


def test_extraction_of_other_pages(spark):
    """Trees of the given pages also read pages with blocks that those lack."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    model = html_extract.fit(pages)
    made = [made_page(k) for k in range(60)]
    df = spark.createDataFrame([(k, "u", p) for k, (p, _) in enumerate(made)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df, model).collect()}
    right = [got[k] == t for k, (_, t) in enumerate(made)]
    assert np.mean(right) >= 0.9


def test_extraction_edges(spark):
    model = html_extract.fit(spark.read.parquet(f"{SF}/pages.parquet"))
    pages = [None, "", "no markup at all", "<article><p>one  <b>two</b>\n three<p>four &lt;b&gt; &am", "<article><h1>x</h1><p>cut <a hr",
             "<p></p></div></article>", "<article>" + "<div>" * 300 + "deep" + "</div>" * 300 + "</article>", "<article><p>" + "long " * 100000, "<html><head><title>t</title><body><nav><ul><li><a href='/'>x</a></li><li><a href='/y'>y</a></li></ul></nav><article><h1>no end of head</h1><p>" + "some words. " * 30 + "</p></article><footer>f</footer>"]
    df = spark.createDataFrame([(1, "u", p, 5, "t") for p in pages], "page_id long, url string, html string, n_chars int, text string")
    got = [r["text"] for r in html_extract.extract(df, model).collect()]
    assert got[0] == got[1] == "" and got[5] == ""
    assert got[3] == "one two three\nfour <b> &am"
    assert got[4] == "x\ncut"
    assert len(got[7]) == 499999
    assert got[8] == "no end of head\n" + ("some words. " * 30).strip()
    assert html_extract.extract(df.limit(0), html_extract.fit(df.limit(0))).count() == 0


@pytest.mark.parametrize("odds", [[3, 3, -1, 3], [3, -1, 3, 3]])
def test_decoding_is_hierarchical(odds):
    page = html_extract.parse("<div>aaaa<div>bbbb<p>cccc</p></div></div>")
    kept = html_extract.decode(page, np.array(odds, dtype=float))
    assert all(not kept[i] or kept[page.parent[i]] or page.parent[i] == 0 or odds[page.parent[i]] <= 0 for i in range(1, 4))


@pytest.mark.parametrize("page, want", [
    ('<nav><svg class="i"/></nav><article><p>one two</p></article>', ["one two"]),
    ("<nav><svg class=i/></nav><p>a <math/> b <math><mi>x</mi><annotation>tex</annotation></math> c</p>", ["a b x c"]),
    ("<div><video src=x></div><p>behind</p>", ["behind"]),
    ("<p>one <object data=x> gone<p>two<div><canvas></div><p>three", ["one", "two", "three"]),
    ("<ul><li>a <audio src=x><li>b</ul><p>c <select><option>o<option>q</select> d", ["a", "b", "c d"]),
    ("<head><noscript><link rel=x><body><p>text</p>", ["text"]),
    ("<p>u <video a></p><p>v</p><video b><p>old browser</p></video><template><div>t</div></template><p>w", ["u", "v", "w"]),
    ("<object-x>a</object-x> <template-card>b</template-card> <video-player>c</video-player> <select-box>d</select-box> <title-x>e", ["a b c d e"]),
    ("<svg><title/><style/><path/></svg><p>a<svg><title>t</title></svg>b</p><script>'<p>no</p>'</script ><p>c", ["ab", "c"]),
])
def test_elements_without_main_text_end(page, want):
    assert [t for _, t, _ in html_extract.parse(page).segments] == want


def test_extraction_behind_hidden_elements(spark):
    model = html_extract.fit(spark.read.parquet(f"{SF}/pages.parquet"))
    body = "<article><h1>head</h1><p>" + "some words. " * 30 + "{}</p><p>" + "more words. " * 30 + "</p></article><footer>f</footer>"
    pages = ["<nav><svg class='i'/></nav>" + body.format(""), body.format("<video src=x>"), body.format("<x-object>") + "<select-box>"]
    df = spark.createDataFrame([(k, "u", p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    want = "\n".join(["head", ("some words. " * 30).strip(), ("more words. " * 30).strip()])
    assert [r["text"] for r in html_extract.extract(df, model).orderBy("page_id").collect()] == [want] * 3


def test_copies_of_a_page_count_once_in_training(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").limit(20)
    rows = [(r["page_id"], r["url"], r["html"]) for r in pages.collect()]
    copies = [(1000 + k, "u", h) for k in range(15) for _, _, h in rows[:3]] + [(2000 + k, "u", "") for k in range(30)]
    schema = "page_id long, url string, html string"
    alone, many = (html_extract.fit(spark.createDataFrame(r, schema).repartition(3), limit=10) for r in (rows, rows + copies))
    assert alone.base == many.base and all((x == y).all() for x, y in zip(alone.leaf, many.leaf, strict=True))


def test_unlabelled_sample_counts_an_id_once(spark):
    rows, labels = made_toxic(5, 300)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    repeated = rows + [rows[k] for k in range(40) for _ in range(30)]
    alone, many = (toxicity.fit(C.docs(spark, r), marks, limit=100) for r in (rows, repeated))
    assert (alone.keys == many.keys).all() and np.allclose(alone.weights, many.weights)
