"""Models against slow versions of themselves: Kneser-Ney estimates, mixing, language choice, page extraction, neighbours."""

import math
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.llm import html, kneser_ney, langid, mixing, neighbours, quality

RNG = np.random.default_rng(11)
SYLLABLES = {"xx": "ba ra ka ta la".split(), "yy": "qui zo wem pril ux".split()}


def prose(lang, n):
    return " ".join("".join(RNG.choice(SYLLABLES[lang], RNG.integers(1, 4))) for _ in range(n))


def estimates(words, order):
    """log10 probabilities and back-off weights of modified Kneser-Ney by (level, backs, gram), straight from the formulas."""
    tables = {order: Counter()}
    for w in words:
        p = " " * (order - 1) + w + " "
        for i in range(len(w) + 1):
            tables[order][p[i : i + order]] += 1
    for k in range(order - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    out, lower = {}, None
    for k in range(1, order + 1):
        n = Counter(tables[k].values())
        d = {}
        for i, rest in ((1, 0.5), (2, 1.5), (3, 2.7)):
            y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0
            d[i] = max(0.05, i - (i + 1) * y * n[i + 1] / n[i]) if n[i] and n[i + 1] else rest
        own = defaultdict(list)
        for g, c in tables[k].items():
            own[g[:-1]].append(c)
        probs = {}
        for g, c in tables[k].items():
            total = sum(own[g[:-1]])
            back = sum(d[min(x, 3)] for x in own[g[:-1]]) / total
            out[k, True, g[:-1]] = math.log10(back)
            q = 1 / kneser_ney.CHARACTERS if lower is None else lower[g[1:]]
            probs[g] = (c - min(d[min(c, 3)], c)) / total + back * q
            out[k, False, g] = math.log10(probs[g])
        lower = probs
    return out


def test_kneser_ney(spark):
    words = {lang: prose(lang, 300).split() for lang in SYLLABLES}
    rows = [(lang, g, c) for lang, own in words.items() for g, c in kneser_ney.gram_counts(Counter(own), 3).items()]
    got = kneser_ney.estimated(spark.createDataFrame(rows, "lang string, gram string, c bigint"), 3).collect()
    for lang, own in words.items():
        want = estimates(own, 3)
        found = {(r["level"], r["backs"], r["gram"]): r["value"] for r in got if r["lang"] == lang}
        assert found.keys() == want.keys()
        assert all(abs(found[k] - want[k]) < 1e-9 for k in want)


def cost_of(model, text, order=3):
    """Mean negative log10 probability a character under estimates(), by backing off gram by gram."""
    total = n = 0
    for w in text.split():
        p = " " * (order - 1) + w + " "
        for i in range(len(w) + 1):
            g = p[i : i + order]
            value = model.get((1, False, g[-1]), model.get((1, True, ""), 0) - math.log10(kneser_ney.CHARACTERS))
            for k in range(2, order + 1):
                own = model.get((k, False, g[-k:]))
                value = own if own is not None else value + model.get((k, True, g[-k:-1]), 0)
            total, n = total - value, n + 1
    return total / n


def test_perplexity_and_threshold(spark):
    texts = {i: prose("xx", 40) for i in range(150)} | {200: prose("yy", 40), 201: "one " + prose("xx", 30), 202: "", 203: None}
    docs = spark.createDataFrame([(i, t, "xx") for i, t in texts.items()], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(140)], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.judged(docs, labels).collect()}
    trusted = quality.trusted_rows(docs, labels).collect()
    model = estimates(" ".join(texts[r["doc_id"]] for r in trusted if r["fitted"]).split(), 3)
    for i, t in texts.items():
        if t:
            assert abs(got[i]["log_perplexity"] - cost_of(model, t)) < 1e-4
    apart = sorted(got[r["doc_id"]]["log_perplexity"] for r in trusted if not r["fitted"])
    assert 0 < len(apart) < 140
    # The limit is a value of documents that the model hasn't seen, raised by the margin.
    assert any(abs(got[200]["threshold"] - x * quality.MARGIN) < 1e-9 for x in apart)
    assert got[200]["rejected"] and not got[202]["rejected"] and not got[203]["rejected"]
    assert sum(got[i]["rejected"] for i in range(150)) == 0


def test_language_scores(spark):
    train = {lang: [prose(lang, 40) for _ in range(30)] for lang in SYLLABLES}
    rows = [(lang, t) for lang, own in train.items() for t in own]
    training = spark.createDataFrame(rows, "lang string, text string")
    asked = [prose("xx", 12), prose("yy", 12), "Ba-ra, ka!", "123 ...", None, ""]
    docs = spark.createDataFrame(list(enumerate(asked)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in langid.identified(docs, training).collect()}
    apart = {r["text"] for r in training.where(F.pmod(F.xxhash64("text"), F.lit(langid.CALIBRATION)) == 0).collect()}
    for lang in train:  # too few are set apart, so all are counted
        assert sum(t in apart for t in train[lang]) < langid.LEAST
    models = {lang: estimates([w for t in own for w in langid.words_of(t)], 3) for lang, own in train.items()}
    for i, t in enumerate(asked):
        words = " ".join(langid.words_of(t or ""))
        if not words:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        costs = {lang: cost_of(m, words) for lang, m in models.items()}
        best = min(costs, key=costs.get)
        assert got[i]["lang_pred"] == best and abs(got[i]["cross_entropy"] - costs[best]) < 1e-4
        assert abs(got[i]["score"] - 1 / sum(10 ** (costs[best] - x) for x in costs.values())) < 1e-4
    # The same by blocks in sharded joins.
    few, langid.MOST_ROWS = langid.MOST_ROWS, 1
    try:
        again = {r["doc_id"]: r for r in langid.identified(docs, training).collect()}
    finally:
        langid.MOST_ROWS = few
    assert {i: r["lang_pred"] for i, r in again.items()} == {i: r["lang_pred"] for i, r in got.items()}


def slowly_mixed(steps, tables, weights, rate):
    """Bits of each text, step by step: what mixed() gives for all texts at once."""
    xs, gate = mixing.inputs(steps, tables)
    out, lo = [], 0
    for hi in steps.ends:
        scale, bits, at, r = np.ones(mixing.CONTEXTS), 0.0, lo, 0
        while at < hi:
            end = min(at + min(mixing.STRETCH << r, mixing.LONGEST), hi)
            grad = np.zeros(mixing.CONTEXTS)
            for i in range(at, end):
                parts = np.array([float(weights[gate[i], k]) * float(xs[k][i]) for k in range(mixing.CONTEXTS)])
                p = 1 / (1 + math.exp(-max(-12, min(12, float(parts @ scale)))))  # probability of a one
                bits -= math.log2(p if steps.bit[i] else 1 - p)
                grad += (p - steps.bit[i]) * parts
            scale = np.clip(scale - rate * grad / math.sqrt(end - at), 0.2, 3)
            at, r = end, r + 1
        out.append(bits)
        lo = hi
    return out


def test_mixing_step_by_step(monkeypatch):
    monkeypatch.setattr(mixing, "STRETCH", 32)
    monkeypatch.setattr(mixing, "LONGEST", 128)
    texts = [mixing.tokens(prose("xx", n).encode()) for n in (60, 1, 150)] + [[]]
    coder = mixing.code(np.bincount(np.frombuffer(b"".join(map(mixing.stream, texts)), np.uint8), minlength=256))
    counts = np.zeros((mixing.CONTEXTS, 2 * mixing.SLOTS), np.uint32)
    mixing.count_steps(texts[:2], coder, counts)
    tables = np.array([mixing.predictors(t[::2].astype(float), t[1::2].astype(float)) for t in counts])
    weights = np.tile(np.array(mixing.START, np.float32), (mixing.GATES, 1))
    steps = mixing.Steps(texts, coder)
    got = mixing.mixed(steps, tables, weights)
    want = slowly_mixed(steps, tables, weights, mixing.RATE)
    assert len(got) == 4 and np.allclose(got, want, rtol=1e-3)


PLAIN = """<html><body><div><div><a href=1>Home</a></div><div><a href=2>About us</a></div><div><a href=3>Contact</a></div></div>
<div><h1>The title</h1><p>A first paragraph, which is long enough, and has commas; it also ends.</p><h2>Part</h2>
<p>A second &amp; longer paragraph, with <b>bold</b> words, and   a\nbreak.</p><ul><li>one, two</li></ul><p>The last paragraph, again with some words, and a stop.</p></div>
<div><div>(c) 2024 Somebody</div><div><a href=4>Imprint</a></div></div></body></html>"""


def test_pages_by_ratios_alone():
    """No class, role or element name tells the menu and the footer apart."""
    assert html.main_text(PLAIN).split("\n") == [
        "The title", "A first paragraph, which is long enough, and has commas; it also ends.", "Part",
        "A second & longer paragraph, with bold words, and a break.", "one, two", "The last paragraph, again with some words, and a stop.",
    ]


@pytest.mark.parametrize("page", ["<div>" * 50_000, '<a t="x ' * 20_000, "<" * 100_000, "<p>" * 50_000 + "x", "<!--" * 20_000, "</p>" * 50_000, "&" * 100_000, "<a href='" + "x" * 200_000])
def test_pages_in_linear_time(page):
    began = time.process_time()
    html.main_text(page)
    assert time.process_time() - began < 3


@pytest.mark.parametrize(("page", "text"), [("", ""), ("a < b <c>d</c> <!-- x", "a < b d"), ("<table><tr><td>a<td>b</table>", "a\nb"), ("<p>x <script>if (a < b) c</script> y", "x y"), ("x&nbsp;&#233;&lt;y", "x é<y"), ("<b>cut off <i", "cut off")])
def test_small_pages(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_recall(spark, size):
    vectors = spark.read.parquet(f"/root/testdata/{size}/embeddings.parquet")
    got = defaultdict(set)
    for r in neighbours.nearest(vectors, vectors.where("vec_id % 100 = 0")).collect():
        got[r["query_id"]].add(r["vec_id"])
    rows = vectors.where(neighbours.VALID).collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    hit = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, d)) if i != q][:10]
        hit += len(got[ids[q]] & {int(ids[i]) for i in order})
        total += len(order)
    assert hit >= 0.9 * total
