"""Personal data: four base patterns, and further spans by a bidirectional LSTM with CRF transitions.

The tagger learns from the base spans of a bounded sample of documents and from disguised forms of them, and reads the whole text in
overlapping windows. A span has a digit, an @ or an `at` in brackets, so windows without one of these can't hold any and are left out.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import save, tidy
from dossier.llm.tagger import Tagger, codes

KINDS = ("email", "ip", "card", "phone")
#: Code points of a window, and from one window's start to the next's.
WINDOW, STRIDE = 160, 96
#: Code points of a training window, and how many of those with and of those without a base span the tagger learns from at most.
SHORT, WITH, WITHOUT = 64, 1200, 600
#: Lessons made of them, each with its own disguises, and how often all are gone through.
LESSONS, EPOCHS = 4000, 8
#: Windows that a worker decodes at once.
BATCH = 512

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# Possessive, and from the start of a run of digits only: the matches are those of the plain patterns, found in linear time.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]|[(\[{] ?[Aa][Tt] ?[)\]}]")
Span = tuple[int, int, int]  # start, number of the kind, end


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return total % 10 == 0


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def small(text: str) -> bool:
    """Whether all numbers in the text are 255 at most."""
    return all(len(x) < 4 and int(x or 0) <= 255 for x in (x.lstrip("0") for x in re.findall("[0-9]+", text)))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The pattern's matches, from each @ outwards: linear, however long the runs of letters are."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = done + len(text[done:at].rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def base(text: str) -> list[Span]:
    """The base spans by start, then kind."""
    out = [(s, 0, e) for s, e in emails(text)]
    if TRIGGER.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if small(m[0])]
        out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if m.end() - m.start() < 38 and 14 <= len(d := digits(m[0])) <= 19 and luhn(d)]
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out)


def shown(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


# ------------------------------------------------------------ what the tagger reads


def windows(text: str) -> list[int]:
    """Numbers of the windows that have a trigger."""
    out, at = [], 0
    while m := TRIGGER.search(text, at):
        p = m.start()
        last = p // STRIDE
        out += [i for i in range(max((p - WINDOW) // STRIDE + 1, 0), last + 1) if not out or i > out[-1]]
        at = (last + 1) * STRIDE
    return out


def segments(text: str) -> list[tuple[int, str]]:
    """(start, text) of runs of neighbouring windows that have a trigger; each start is one of a window."""
    found = windows(text)
    cuts = [i for i in range(1, len(found)) if found[i] != found[i - 1] + 1]
    return [(found[a] * STRIDE, text[found[a] * STRIDE : found[b - 1] * STRIDE + WINDOW]) for a, b in zip([0, *cuts], [*cuts, len(found)], strict=True) if a < b]


def examples(text: str, spans: list[Span]) -> list[tuple[bool, str]]:
    """At most one window about a base span and one about a trigger away from them, chosen by the text's CRC."""
    code = zlib.crc32(text.encode())
    around = lambda p: text[max(p - 8 - code % 16, 0) :][:SHORT]
    out = [(True, around(spans[code % len(spans)][0]))] if spans else []
    if found := windows(text):
        p = TRIGGER.search(text, found[code % len(found)] * STRIDE).start()
        if all(p < s - SHORT or p > e + SHORT for s, _, e in spans):
            out.append((False, around(p)))
    return out


# ------------------------------------------------------------ training


def disguised(kind: int, text: str, rng: np.random.Generator) -> str:
    """Another way to write a base span."""
    pick = lambda *x: x[rng.integers(len(x))]
    d = digits(text)
    if kind == 0:
        at, dot = pick((" (at) ", "."), ("[at]", "."), ("(at)", "(dot)"), (" @ ", "."), (" [at] ", " [dot] "))
        local, _, domain = text.partition("@")
        return local + at + domain.replace(".", dot)
    if kind == 1:
        return text.replace(".", pick("[.]", "(.)", " . "))
    if kind == 2:
        return pick(".", "/", "_", "  ").join(d[i : i + 4] for i in range(0, len(d), 4))
    tail = [d[2:5], d[5:8], d[8:]]
    return pick("(0{}) {}-{}", "0{}/{}{}", "00" + d[:2] + " {} {} {}", "0{} {} {}", "0{}-{}-{}").format(*tail)


def harmless(rng: np.random.Generator) -> str:
    """Digits that are no personal data."""
    n = lambda lo, hi: int(rng.integers(lo, hi))
    forms = (
        lambda: f"{n(1900, 2030)}-{n(1, 13):02}-{n(1, 29):02}",
        lambda: f"{n(1, 29)}.{n(1, 13)}.{n(1900, 2030)}",
        lambda: f"{n(1, 29):02}/{n(1, 13):02}/{n(1900, 2030)}",
        lambda: f"{n(0, 24):02}:{n(0, 60):02}:{n(0, 60):02}",
        lambda: f"{n(1, 999)},{n(0, 1000):03}.{n(0, 100):02}",
        lambda: f"{n(1800, 2030)}-{n(1800, 2030)}",
        lambda: f"v{n(0, 30)}.{n(0, 30)}.{n(0, 100)}",
        lambda: str(n(0, 10 ** n(1, 9))),
        lambda: "".join(map(str, rng.integers(0, 10, n(12, 26)))),
        lambda: "".join("0123456789abcdef"[i] for i in rng.integers(0, 16, n(16, 41))),
        lambda: f"{n(0, 10 ** 9):09}@",
        lambda: f"{n(10, 100)} {n(100, 1000)} {n(100, 1000)} {n(100, 1000)}",
    )
    return forms[rng.integers(len(forms))]()


def lesson(text: str, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, tags) of a training window: its base spans, half of them disguised, and now and then harmless digits in it."""
    spans, out, marks, at = base(text), "", [], 0
    for s, k, e in spans:
        if s < at:
            continue
        said = disguised(k, text[s:e], rng) if rng.random() < 0.5 else text[s:e]
        out += text[at:s]
        marks.append((len(out), k, len(out) + len(said)))
        out, at = out + said, e
    out += text[at:]
    if rng.random() < 0.3 and (spaces := [m.start() for m in re.finditer(" ", out) if all(m.start() < s or m.start() >= e for s, _, e in marks)]):
        p, extra = spaces[rng.integers(len(spaces))], " " + harmless(rng)
        out = out[:p] + extra + out[p:]
        marks = [(s + len(extra) * (s >= p), k, e + len(extra) * (s >= p)) for s, k, e in marks]
    tags = np.zeros(SHORT, np.int64)
    for s, k, e in marks:
        if e <= SHORT:
            tags[s] = 2 * k + 1
            tags[s + 1 : e] = 2 * k + 2
        else:
            out = out[:s]
    return codes(out, SHORT), tags


def trained(texts: list[str], lessons: int = LESSONS, epochs: int = EPOCHS) -> Tagger:
    """A tagger of windows of text; the same for the same windows in the same order."""
    rng = np.random.default_rng(13)
    x, y = (np.stack(v) for v in zip(*(lesson(texts[i % len(texts)], rng) for i in range(lessons)), strict=True))
    out = Tagger(len(KINDS))
    out.fit(x, y, epochs)
    return out


# ------------------------------------------------------------ decoding

MAIL_LIKE = re.compile(r"(?i)[\w.%+-]{1,64} ?(?:@|[(\[{] ?at ?[)\]}]) ?[\w-]{1,63}(?: ?(?:\.|[(\[{] ?dot ?[)\]}]) ?[\w-]{1,63})+")
IP_LIKE = re.compile(r"[0-9]+(?: ?[\[(]?\.[\])]? ?[0-9]+){3}")
CARD_LIKE = re.compile(r"[0-9](?:[ ./_-]{0,2}[0-9])+")
PHONE_LIKE = re.compile(r"(?:\+|0|\(\+?0)[ ().\/0-9-]*[0-9]")


def plausible(kind: int, text: str) -> bool:
    """Whether a span that the tagger proposes can be of the kind: weaker than the base patterns, but with their check digits and bounds."""
    if len(text) > 254:
        return False
    d = digits(text)
    if kind == 0:
        return bool(MAIL_LIKE.fullmatch(text))
    if kind == 1:
        return bool(IP_LIKE.fullmatch(text)) and small(text)
    if kind == 2:
        return bool(CARD_LIKE.fullmatch(text)) and 14 <= len(d) <= 19 and luhn(d)
    return bool(PHONE_LIKE.fullmatch(text)) and 9 <= len(d) <= 15


def proposed(tags: np.ndarray, text: str) -> list[Span]:
    """The spans that a window's tags mark, without white space at their ends."""
    out = []
    first = np.flatnonzero(tags % 2 == 1)
    for s in first:
        k = int(tags[s]) // 2
        e = int(s) + 1
        while e < len(text) and tags[e] == 2 * k + 2:
            e += 1
        if s < len(text) and (said := text[s:e]).strip():
            s = int(s) + len(said) - len(said.lstrip())
            out.append((s, k, s + len(said.strip())))
    return out


def reconciled(spans: list[Span], fixed: list[Span], text_of: Callable[[int, int], str]) -> list[Span]:
    """What the windows of a text propose, as one list: overlapping spans of a kind become one, of different kinds the longer stays (then
    the earlier, then the kind listed first), those that aren't plausible or touch a base span go; the base spans stay."""
    whole: dict[int, list[Span]] = {}
    for s, k, e in sorted(spans):
        own = whole.setdefault(k, [])
        if own and s < own[-1][2]:
            own[-1] = (own[-1][0], k, max(own[-1][2], e))
        else:
            own.append((s, k, e))
    good = [x for own in whole.values() for x in own if plausible(x[1], text_of(x[0], x[2]))]
    taken: list[tuple[int, int]] = []
    for s, e in sorted((s, e) for s, _, e in fixed):
        if taken and s < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(taken[-1][1], e))
        else:
            taken.append((s, e))
    out: list[Span] = []
    for s, k, e in sorted(good, key=lambda x: (x[0] - x[2], x)):
        i = bisect.bisect_left(taken, (e, 0))
        if i == 0 or taken[i - 1][1] <= s:
            out.append((s, k, e))
            taken.insert(i, (s, e))
    return sorted([*fixed, *out])


SCAN = "doc_id bigint, spans array<struct<s:int,k:int,e:int>>, segments array<struct<start:int,text:string>>, examples array<struct<has:boolean,text:string>>"
FOUND = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"


def scanned(docs: DataFrame) -> DataFrame:
    """Each document's base spans and the parts of its text that the tagger reads, in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32())]))), ("segments", pa.list_(pa.struct([("start", pa.int32()), ("text", pa.string())]))), ("examples", pa.list_(pa.struct([("has", pa.bool_()), ("text", pa.string())])))])
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                spans, parts, seen = [], [], []
                for t in part.column("text"):
                    text = t.as_py() or ""
                    found = base(text)
                    spans.append([{"s": s, "k": k, "e": e} for s, k, e in found])
                    parts.append([{"start": s, "text": x} for s, x in segments(text)])
                    seen.append([{"has": h, "text": x} for h, x in examples(text, found)] if parts[-1] else [])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(v, t.type) for v, t in zip((spans, parts, seen), list(schema)[1:], strict=True))], schema=schema)
        tidy()

    return save(docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, SCAN), "scanned")


def fitted(scan: DataFrame) -> Tagger | None:
    """The tagger trained on WITH and WITHOUT windows at most, those of least hash, in one task; none if no document has a base span."""
    each = scan.select(F.inline("examples")).distinct().withColumn("h", F.xxhash64("text"))
    some = each.where("has").orderBy("h", "text").limit(WITH).unionByName(each.where("not has").orderBy("h", "text").limit(WITHOUT))
    some = save(some, "examples")
    if not some.where("has").head(1):
        return None

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = pdf.sort_values(["has", "h", "text"])["text"].tolist()
        return pd.DataFrame({"model": [trained(texts).dumped()]})

    return Tagger.loaded(bytes(some.groupBy(F.lit(1).alias("all")).applyInPandas(fit, "model binary").first()["model"]), len(KINDS))


def spans_of(rows: list[tuple[list[Span], list[tuple[int, str]]]], tagger: Tagger | None) -> list[list[Span]]:
    """All spans of documents given as (base spans, segments)."""
    own = [(i, start + lo, text[lo : lo + WINDOW]) for i, (_, parts) in enumerate(rows) for start, text in parts for lo in range(0, max(len(text) - WINDOW + STRIDE, 1), STRIDE)] if tagger else []
    found: list[list[Span]] = [[] for _ in rows]
    for lo in range(0, len(own), BATCH):
        some = own[lo : lo + BATCH]
        for (i, start, text), tags in zip(some, tagger.decoded(np.stack([codes(x, WINDOW) for *_, x in some])), strict=True):
            found[i] += [(start + s, k, start + e) for s, k, e in proposed(tags, text)]

    def said(parts: list[tuple[int, str]], s: int, e: int) -> str:
        start, text = parts[bisect.bisect_right(parts, s, key=lambda x: x[0]) - 1]
        return text[s - start : e - start]

    return [reconciled(f, fixed, lambda s, e, parts=parts: said(parts, s, e)) if f else fixed for f, (fixed, parts) in zip(found, rows, strict=True)]


def personal_data(docs: DataFrame) -> DataFrame:
    """For each of docs (doc_id, text): doc_id, the numbers of base spans, their digest, and all spans, as text.

    Spans are kind:start:end in code points, end exclusive, by start, then kind as in KINDS. Null text is empty and has none; other
    columns are ignored; rows of equal doc_id count each for itself. Without any base span in the table there is nothing to learn from
    and the tagger adds none.
    """
    scan = scanned(docs)
    tagger = fitted(scan)
    model = docs.sparkSession.sparkContext.broadcast(tagger.dumped() if tagger else None)  # about 50 kB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Tagger.loaded(model.value, len(KINDS)) if model.value else None
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                rows = [([(x["s"], x["k"], x["e"]) for x in s.as_py()], [(x["start"], x["text"]) for x in g.as_py()]) for s, g in zip(part.column("spans"), part.column("segments"), strict=True)]
                counts = [[sum(k == n for _, k, _ in fixed) for fixed, _ in rows] for n in range(len(KINDS))]
                shas = [hashlib.sha256(shown(fixed).encode()).hexdigest() for fixed, _ in rows]
                names = [f.split()[0] for f in FOUND.split(", ")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas), pa.array([shown(x) for x in spans_of(rows, own)], pa.string())], names=names)
        tidy()

    return scan.select("doc_id", "spans", "segments").mapInArrow(run, FOUND)
