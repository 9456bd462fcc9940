"""Removal of repeated strings with the first occurrence kept, and of repeated lines, against brute force."""

import re

import pytest

from dossier.llm import lines, suffixes

SHARED = "It was a bright cold day in April, and the clocks were striking thirteen over the whole of the long grey street. "
TEXTS = [
    None,
    "",
    "x",
    "a b " * 80,
    SHARED * 2 + "one",
    "two " + SHARED * 2,
    "two " + SHARED * 2,
    "ö" * 150 + SHARED[:90],
    "é" + "ö" * 150 + "three",
    "".join(f"{i} other words. " for i in range(60)),
    "tail " + "".join(f"{i} other words. " for i in range(20, 45)) + "end",
]


@pytest.fixture(scope="module")
def rows(spark):
    names = "doc_id bigint, text string, n_chars int, `_rid` string, kept string, units int, row string, spans string, `key` string"
    return spark.createDataFrame([(i, t, len(t or ""), "r", "k", 1, "w", "s", "y") for i, t in enumerate(TEXTS)], names)


def brute(texts, length):
    seen, out = set(), []
    for t in texts:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            s = data[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(s)
        out.append(bytes(x for x, g in zip(data, gone, strict=True) if not g).decode("utf-8", "ignore"))
    return out


@pytest.mark.parametrize("length", [50, 120])
def test_drop_repeats_keeps_the_first(rows, length):
    got = {r["doc_id"]: r for r in suffixes.drop_repeats(rows.repartition(1), length).collect()}
    # Rows are numbered by place, which a repartition into one part keeps.
    order = [r["doc_id"] for r in rows.repartition(1).collect()]
    want = dict(zip(order, brute([TEXTS[i] for i in order], length), strict=True))
    assert {i: r["text"] or "" for i, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"] or "") and r["_rid"] == "r" and r["key"] == "y" for r in got.values())
    assert got[0]["text"] is None


def test_hot_windows_keep_the_first(rows):
    some = rows.select("text").coalesce(1)
    keys = "_rid", "n", "copies", "spans"
    plain, hot = ({r["_rid"]: tuple(r[k] for k in keys) for r in suffixes.repeats(some, 60, hot=h, keep_first=True).collect()} for h in (10**6, 1))
    assert plain == hot and any(x[3] for x in plain.values())


def test_all_occurrences_go(rows):
    got = {r["doc_id"]: r["text"] for r in suffixes.drop_repeats(rows, 100, keep_first=False).collect()}
    assert got[5] == got[6] == "" and SHARED[:100] not in got[4]
    assert suffixes.drop_repeats(rows.limit(0)).columns == rows.columns and suffixes.drop_repeats(rows.limit(0)).count() == 0


def line_brute(texts, least, short):
    first, out = {}, {}
    for i, t in enumerate(texts):
        if t is None:
            out[i] = None, []
            continue
        units = re.split(r"(?<=[.!?]\s)|(?<=\n)", t)
        forms = [" ".join(re.split(r"[ \t\n\x0b\f\r]+", u)).strip(" ").lower() for u in units]
        words = [len(f.split(" ")) if f else 0 for f in forms]
        known = [words[k] >= short and first.setdefault(f, (i, k)) != (i, k) for k, f in enumerate(forms)]
        spans, kept, k = [], "", 0
        where = [0]
        for u in units:
            where.append(where[-1] + len(u))
        while k < len(units):
            if not known[k]:
                kept, k = kept + units[k], k + 1
                continue
            e = last = k
            while e < len(units) and (known[e] or words[e] < short):
                last = e if known[e] else last
                e += 1
            if sum(words[j] for j in range(k, last + 1) if known[j]) >= least:
                spans.append((where[k], where[last + 1]))
            else:
                kept += "".join(units[k : last + 1])
            k = last + 1
        out[i] = kept, spans
    return out


@pytest.mark.parametrize(("least", "short"), [(1, 1), (12, 1), (20, 4), (8, 3)])
def test_lines(spark, rows, least, short):
    texts = [*TEXTS, "A line of five words\n\n  a LINE of five  words\nnew one\n", "a line of five words\nnew one\nand more. And more. Yet! And more.", "\n\n", "a. b\tc? d"]
    docs = spark.createDataFrame([(i, t, "u", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, `_rid` string, n_units int").repartition(3)
    got = {r["doc_id"]: r for r in lines.drop_repeated_lines(docs, least, short).collect()}
    want = line_brute(texts, least, short)
    assert {i: (r["text"], [tuple(s) for s in r["spans"]]) for i, r in got.items()} == want
    assert all(r["_rid"] == "u" for r in got.values())
    assert lines.drop_repeated_lines(docs.limit(0)).count() == 0
    null = lines.drop_repeated_lines(spark.createDataFrame([(None, "Same words here again and more."), (1, "Same words here again and more.")], "doc_id bigint, text string"), 1)
    assert {r["doc_id"]: r["text"] for r in null.collect()} == {None: "Same words here again and more.", 1: ""}
