"""Personal data: base spans against the plain patterns, the tagger's gradients and what it finds in held-out text."""

import hashlib
import re

import numpy as np
import pytest

from dossier.llm import pii
from dossier.llm.tagger import SIZE, Tagger

RNG = np.random.default_rng(31)
WORDS = ["".join(RNG.choice(list("abcdeilnorst"), 5)) for _ in range(200)] + ["Zoë", "at", "Übung", "2024", "No. 7"]
PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain(text):
    out = []
    for k, p in enumerate(PLAIN):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if [True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 14 <= len(d) <= 19 and pii.luhn(d), 10 <= len(d) <= 15][k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def number(n):
    return "".join(map(str, RNG.integers(0, 10, n)))


def made(kind):
    if kind == 0:
        return f"{RNG.choice(WORDS[:200])}.{RNG.choice(WORDS[:200])}{number(2)}@{RNG.choice(WORDS[:200])}.example"
    if kind == 1:
        return ".".join(map(str, RNG.integers(0, 256, 4)))
    if kind == 2:
        body = number(15)
        return next(body + c for c in "0123456789" if pii.luhn(body + c))
    return f"+{RNG.integers(1, 90)} ({number(3)}) {number(3)}-{number(4)}"


def prose(n):
    return " ".join(RNG.choice(WORDS, n))


def document(kinds):
    return " ".join(x for k in kinds for x in (prose(int(RNG.integers(5, 60))), made(k))) + " " + prose(20)


DOCS = [document(RNG.integers(0, 4, 3)) for _ in range(250)]
ODD = ["", " ", "a@b.c_d@e.f", "x@y", "@@a.b@c.d.", "1.2.3.4.5.6.7.8", "256.1.1.1 01.002.0003.4", "4111 1111-1111 1111", "4111111111111111" * 3, "+1 (23) 45.6789-0+12345678901", "+(((", "1.2.3.4@5.6.7.8", "é@ü.de a@b.c", "+1234567890123456"]


@pytest.mark.parametrize("text", [*ODD, "".join(RNG.choice(list("a1.@+ -()é"), 4000)), "".join(RNG.choice(list("1. +-"), 4000)), *DOCS[:20]])
def test_base(text):
    assert pii.base(text) == plain(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 1_000_000, "1" * 1_000_000, "@" * 300_000, "a@" * 300_000, "1 " * 500_000, "+" + "(" * 1_000_000):
        pii.base(text)
        pii.segments(text)


def test_windows_cover_each_trigger():
    text = document([0, 1, 2, 3] * 5) + prose(2000) + "9"
    covered = {i for s, t in pii.segments(text) for i in range(s, s + len(t))}
    assert all(m.start() in covered for m in pii.TRIGGER.finditer(text))
    assert all(text[s : s + len(t)] == t and s % pii.STRIDE == 0 for s, t in pii.segments(text))


def test_gradients():
    t = Tagger(2)
    x, y = RNG.integers(0, SIZE, (3, 6)), np.array([[0, 1, 2, 2, 0, 3], [1, 0, 0, 3, 4, 4], [0] * 6])
    _, g = t.gradients(x, y)
    for k, a in t.p.items():
        at = (0, x[0, 2], 5) if k == "in" else tuple(0 if n == 1 else 1 for n in a.shape)
        old, e = a[at], 0.05
        a[at] = old + e
        up = t.gradients(x, y)[0]
        a[at] = old - e
        down = t.gradients(x, y)[0]
        a[at] = old
        assert abs((up - down) / 2 / e - g[k][at]) < 0.01, k


def test_decoding_keeps_to_the_tags_order():
    t = Tagger(2)
    tags = t.decoded(RNG.integers(0, SIZE, (20, 30)))
    for row in tags:
        for a, b in zip([0, *row], row, strict=False):
            assert b == 0 or b % 2 or a in (b, b - 1)


@pytest.fixture(scope="module")
def tagger():
    texts = sorted({x for d in DOCS[:150] for _, x in pii.examples(d, pii.base(d))})
    return pii.trained(texts)


def test_held_out(tagger):
    held = [(d, pii.base(d)) for d in DOCS[150:]]
    alone = pii.spans_of([([], pii.segments(d)) for d, _ in held], tagger)
    total = sum(len(b) for _, b in held)
    hit = sum(len(set(b) & set(f)) for (_, b), f in zip(held, alone, strict=True))
    assert hit / total >= 0.8 and hit / sum(map(len, alone)) >= 0.9
    hit = 0
    for d, b in held:
        s, k, e = b[0]
        said = pii.disguised(k, d[s:e], RNG)
        text = d[:s] + said + d[e:]
        found = pii.spans_of([(pii.base(text), pii.segments(text))], tagger)[0]
        assert set(pii.base(text)) <= set(found)
        hit += any(q == k and a <= s + 1 and z >= s + len(said) - 1 for a, q, z in found)
    assert hit / len(held) >= 0.7


def test_clean_texts_are_left_alone(tagger):
    clean = [f"{prose(30)} {pii.harmless(RNG)} {prose(30)}" for _ in range(300)]
    found = pii.spans_of([(pii.base(t), pii.segments(t)) for t in clean], tagger)
    assert sum(bool(f) and not pii.base(t) for f, t in zip(found, clean, strict=True)) <= 3


def test_reconciled():
    card = "4111.1111.1111.1111"
    text = f"{card} a@b.cd x"
    of = lambda s, e: text[s:e]
    assert pii.reconciled([(0, 2, 12), (5, 2, 19), (0, 3, 12)], [(20, 0, 26)], of) == [(0, 2, 19), (20, 0, 26)]
    assert pii.reconciled([(22, 0, 26)], [(20, 0, 26)], of) == [(20, 0, 26)]


def test_personal_data(spark):
    rows = [(i, t, 1, "s") for i, t in enumerate([*DOCS[:60], *ODD, DOCS[0], None])] + [(None, DOCS[1], 1, "s"), (0, DOCS[0], 1, "s")]
    got = pii.personal_data(spark.createDataFrame(rows, "doc_id bigint, text string, n_ip int, spans string").repartition(3)).collect()
    assert len(got) == len(rows)
    want = sorted(str((i, *(sum(k == n for _, k, _ in plain(t or "")) for n in range(4)), hashlib.sha256(pii.shown(plain(t or "")).encode()).hexdigest())) for i, t, *_ in rows)
    assert sorted(str(tuple(r)[:6]) for r in got) == want
    by = {r["doc_id"]: r["spans"] for r in got}
    assert all(set(pii.shown(plain(t or "")).split(",")) - {""} <= set(by[i].split(",")) for i, t, *_ in rows if i is not None)


def test_nothing_to_learn_from(spark):
    schema = "doc_id bigint, text string"
    assert pii.personal_data(spark.createDataFrame([], schema)).count() == 0
    assert [r["spans"] for r in pii.personal_data(spark.createDataFrame([(1, "year 2024"), (2, None)], schema)).collect()] == ["", ""]
