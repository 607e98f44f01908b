"""Secrets in texts: fixed patterns, and a battery of randomness tests with control of
false discoveries by length.

The battery judges runs of LEAST or more characters of the base-64 alphabets. A run's
encoding is the smallest alphabet that holds it. In the hypothesis that the run is random
in that alphabet, three tests give probabilities: chi-squared of its symbols' counts (by a
gamma distribution of the exact mean and variance, as counts are small), the number of runs
above and below the middle of the alphabet, and the correlation of each symbol with the
next. Fisher's method combines them. Random runs have any combined probability, ordinary
text mostly a tiny one; but short text can look random. How often it does is measured on
the corpus itself: the letters and digits of all texts, without candidates and found
secrets, are cut into decoys of the length classes' least lengths and go through the same
battery. A candidate's p-value is the share of its class's decoys that have its encoding
and look as random or more, times the number of encodings. Benjamini and Hochberg's
procedure over the candidates of each length class keeps the expected share of false
discoveries at ``rate``. So a run that is too short to tell from text is not added, however
random it looks, and long words do not hide a few long secrets.

Two passes: one reads the texts once and gives each row's patterns and candidates, as
spans and cells (length class, encoding, step of the probability), and the counts of
decoys by cell. The cells, some thousands, decide on the driver; the second pass reads no
text and keeps the candidates of accepted cells.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.llm.common import drop_staged, lean, slices, staged, table
from barlab.llm.decontaminate import arrow_type

KINDS = ("assign", "access", "hex", "random")  # in the order of equal starts
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16
SLICE_BYTES, LEAST, STEPS = 1 << 20, 16, 128

_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
_UPPER = _LOWER.upper()
#: Name and symbols in order, the smaller first. Digits alone are numbers, not secrets.
ENCODINGS = [
    ("digits", _DIGITS), ("hex", _DIGITS + "abcdef"), ("HEX", _DIGITS + "ABCDEF"), ("lower", _LOWER), ("UPPER", _UPPER), ("base32", _UPPER + "234567"), ("lower36", _DIGITS + _LOWER), ("UPPER36", _DIGITS + _UPPER),
    ("letters", _UPPER + _LOWER), ("base62", _UPPER + _LOWER + _DIGITS), ("base64", _UPPER + _LOWER + _DIGITS + "+/"), ("base64url", _UPPER + _LOWER + _DIGITS + "-_"), ("mixed", _UPPER + _LOWER + _DIGITS + "+/-_"),
]
SIZE = np.array([len(s) for _, s in ENCODINGS])
HOLDS, INDEX = np.zeros(256, np.int64), np.zeros((len(ENCODINGS), 256), np.int64)
for _e, (_, _s) in enumerate(ENCODINGS):
    HOLDS[list(_s.encode())] |= 1 << _e
    INDEX[_e, list(_s.encode())] = np.arange(len(_s))
TOKEN, HEX = HOLDS > 0, HOLDS & 2 > 0
PLAIN = HOLDS >> 9 & 1 > 0  # letters and digits
#: Least lengths of the classes: half powers of two.
CLASSES = [math.ceil(LEAST * 2 ** (i / 2)) for i in range(9)]


def _erfc(x: np.ndarray) -> np.ndarray:
    """Complementary error function of numbers from 0, by a rational approximation (1.2e-7 of the value)."""
    t = 1 / (1 + x / 2)
    c = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)  # fixed values
    return t * np.exp(-x * x + np.polynomial.polynomial.polyval(t, c))


def two_sided(z: np.ndarray) -> np.ndarray:
    return _erfc(np.abs(z) / math.sqrt(2))


def upper_tail(z: np.ndarray) -> np.ndarray:
    p = _erfc(np.abs(z) / math.sqrt(2)) / 2
    return np.where(z >= 0, p, 1 - p)


def battery(chars: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Encoding, and combined probability of the tests, of runs of bytes that follow each other."""
    m = len(lengths)
    starts = np.cumsum(lengths) - lengths
    mask = np.bitwise_and.reduceat(HOLDS[chars], starts)
    encoding = np.log2((mask & -mask).astype(float)).astype(np.int64)
    owner = np.repeat(np.arange(m), lengths)
    code = INDEX[encoding[owner], chars]
    n, a = lengths.astype(float), SIZE[encoding].astype(float)

    counts = np.bincount(owner * 66 + code, minlength=m * 66).reshape(m, 66)
    chi = (counts.astype(float) ** 2).sum(1) * a / n - n
    mean, variance = a - 1, 2 * (a - 1) * (1 - 1 / n)
    shape = mean * mean / variance  # of a gamma distribution, taken to the normal one by its cube root
    fit = upper_tail((np.cbrt(chi / mean) - (1 - 1 / (9 * shape))) * np.sqrt(9 * shape))

    high = 2 * code >= SIZE[encoding][owner]
    inner = np.ones(len(chars), bool)
    inner[starts] = False
    above = np.add.reduceat(high.astype(float), starts)
    below = n - above
    turns = np.add.reduceat((inner & np.concatenate([[False], high[1:] != high[:-1]])).astype(float), starts) + 1
    expected = 2 * above * below / n + 1
    spread = np.maximum((expected - 1) * (expected - 2) / np.maximum(n - 1, 1), 1e-9)
    alternation = two_sided((turns - expected) / np.sqrt(spread))

    away = code - (np.add.reduceat(code.astype(float), starts) / n)[owner]
    square = np.add.reduceat(away * away, starts)
    product = np.add.reduceat(np.where(inner, away * np.concatenate([[0.0], away[:-1]]), 0.0), starts)
    r = np.where(square > 0, product / np.maximum(square, 1e-9), 1.0)
    serial = two_sided((r + 1 / n) * np.sqrt(n))

    half = -np.log(np.maximum(np.stack([fit, alternation, serial]), 1e-300)).sum(0)
    return encoding, np.exp(-half) * (1 + half + half * half / 2)  # chi-squared of six degrees


def length_class(lengths: np.ndarray) -> np.ndarray:
    return np.searchsorted(CLASSES, lengths, "right") - 1


def cells(chars: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Cell of each run: length class, encoding, and step of the probability, of which the
    first is the most random."""
    encoding, p = battery(chars, lengths)
    step = np.minimum(np.floor(-4 * np.log2(np.maximum(p, 2.0**-40))), STEPS - 1).astype(np.int64)
    return (length_class(lengths) * len(ENCODINGS) + encoding) * STEPS + step


def runs_of(mask: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the runs of marked places that are long enough."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    starts, stops = edges[::2], edges[1::2]
    long = stops - starts >= least
    return starts[long], stops[long]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns but runs of hex digits."""
    out = []
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    low = text.lower()
    if "key" in low or "passw" in low or "token" in low or "secret" in low:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    return out


def _decoys(raw: np.ndarray, free: np.ndarray) -> list[np.ndarray]:
    """Cells of the decoys of a slice: its free letters and digits in order, an equal number of
    each length."""
    stream = raw[free & PLAIN[raw]]
    each = len(stream) // sum(CLASSES)
    out, at = [], 0
    for length in CLASSES:
        if each:
            out.append(cells(stream[at : at + each * length], np.full(each, length)))
        at += each * length
    rest = stream[at:]  # shorter than one decoy of each length: the lengths in turn
    lengths = [n for n, total in zip(CLASSES, np.cumsum(CLASSES).tolist(), strict=True) if total <= len(rest)]
    if lengths:
        out.append(cells(rest[: sum(lengths)], np.array(lengths)))
    return out


def _scan(id_type: pa.DataType):
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    candidate = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cell", pa.int32())])
    schema = pa.schema([("doc_id", id_type), ("spans", pa.list_(span)), ("candidates", pa.list_(candidate)), ("cell", pa.int32()), ("n", pa.int64())])

    def part(ids: pa.Array, texts: list[bytes], decoys: np.ndarray) -> pa.RecordBatch:
        sizes = np.array([len(t) for t in texts], np.int64)
        first = np.cumsum(sizes + 1) - sizes - 1
        raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        place = np.cumsum((raw & 0xC0) != 0x80)  # code points up to and with each byte
        at = lambda b, d: place[b] - place[first[d]]  # noqa: E731  a byte's code point in its text
        spans: list[list[tuple[int, int, int]]] = [base_spans(t.decode("utf-8", "replace")) for t in texts]
        starts, stops = runs_of(HEX[raw], LEAST_HEX)
        docs = np.searchsorted(first, starts, "right") - 1
        for d, a, b in zip(docs.tolist(), at(starts, docs).tolist(), at(stops, docs).tolist(), strict=True):
            spans[d].append((a, 2, b))
        spans = [sorted(s) for s in spans]

        starts, stops = runs_of(TOKEN[raw], LEAST)
        free = np.ones(len(raw), bool)
        for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
            free[a:b] = False
        docs = np.searchsorted(first, starts, "right") - 1
        low, high = at(starts, docs), at(stops, docs)
        open_ = np.array([not any(a < e and s < b for s, _, e in spans[d]) for d, a, b in zip(docs.tolist(), low.tolist(), high.tolist(), strict=True)], bool)
        starts, stops, docs, low, high = (v[open_] for v in (starts, stops, docs, low, high))
        candidates: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        if len(starts):
            n = stops - starts
            where = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n)
            for d, a, b, c in zip(docs.tolist(), low.tolist(), high.tolist(), cells(raw[where], n).tolist(), strict=True):
                candidates[d].append((a, b, c))
        for found in _decoys(raw, free):
            np.add.at(decoys, found, 1)
        dicts = lambda rows, names: [[dict(zip(names, r, strict=True)) for r in of] for of in rows]
        return pa.RecordBatch.from_arrays([ids, pa.array(dicts(spans, ("start", "kind", "end")), pa.list_(span)), pa.array(dicts(candidates, ("start", "end", "cell")), pa.list_(candidate)), pa.nulls(len(texts), pa.int32()), pa.nulls(len(texts), pa.int64())], schema=schema)

    def run(batches):
        decoys = np.zeros(len(CLASSES) * len(ENCODINGS) * STEPS, np.int64)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for a, b in slices(pa.compute.binary_length(texts).fill_null(0).to_pylist(), SLICE_BYTES):
                yield part(batch.column(0).slice(a, b - a), [t or b"" for t in texts[a:b].to_pylist()], decoys)
        used = np.flatnonzero(decoys)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(used), id_type), pa.nulls(len(used), schema.field("spans").type), pa.nulls(len(used), schema.field("candidates").type), pa.array(used, pa.int32()), pa.array(decoys[used])], schema=schema)

    return run


def accepted(decoys: dict[int, int], candidates: dict[int, int], rate: float) -> list[int]:
    """Cells of discoveries: Benjamini and Hochberg over the candidates of each length
    class, whose p-value is that of their cell."""
    count = np.zeros((len(CLASSES), len(ENCODINGS), STEPS))
    for c, n in decoys.items():
        count.reshape(-1)[c] = n
    as_random = np.cumsum(count, 2)
    p = np.minimum(1.0, (len(ENCODINGS) - 1) * (as_random + 1) / (count.sum((1, 2), keepdims=True) + 1))
    p[:, 0] = 1.0  # digits alone
    p = p.reshape(-1)
    out = []
    for of in range(len(CLASSES)):
        held = sorted((c for c in candidates if c // (len(ENCODINGS) * STEPS) == of), key=lambda c: p[c])
        total, best, seen = sum(candidates[c] for c in held), -1.0, 0
        for i, c in enumerate(held):
            seen += candidates[c]
            if (i + 1 == len(held) or p[held[i + 1]] > p[c]) and p[c] <= rate * seen / total:
                best = p[c]
        out += [c for c in held if p[c] <= best]
    return out


def find_secrets(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.01) -> DataFrame:
    """(doc_id, spans) for each row: its secrets (start, kind, end), by start and then kind,
    in code points, the end exclusive. Kinds are those of KINDS: three patterns, and what
    the battery adds, which overlaps none of them. Null and empty texts have none; whether
    a run is added depends on all texts of the table. Rows that repeat count and are
    returned as often as they occur; other columns are ignored."""
    spark, id_type = documents.sparkSession, arrow_type(documents, id_col)
    kind = documents.schema[id_col].dataType.simpleString()
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {kind}, spans array<struct<start:int,kind:int,end:int>>, candidates array<struct<start:int,end:int,cell:int>>, cell int, n bigint"
    scanned, path = staged(docs.mapInArrow(lean(_scan(id_type)), schema), "secrets")
    rows = scanned.filter("spans is not null")
    decoys = {r.cell: r.n for r in scanned.filter("spans is null").groupBy("cell").agg(F.sum("n").alias("n")).collect()}  # cells: some thousands
    candidates = {r.cell: r.n for r in rows.select(F.explode("candidates.cell").alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).collect()}
    good = accepted(decoys, candidates, rate)
    added = F.transform(F.filter("candidates", lambda c: c["cell"].isin(good)), lambda c: F.struct(c["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), c["end"].alias("end")))
    out, _ = staged(rows.select("doc_id", F.array_sort(F.concat("spans", added)).alias("spans")), "secret-spans")
    drop_staged(spark, path)
    return out


def op13_secrets(spark, sf_dir: str) -> DataFrame:
    """Counts and digests of each document's secrets."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    names = F.array(*map(F.lit, KINDS))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint")
    base = F.filter("spans", lambda s: s["kind"] < KINDS.index("random"))
    return found.select("doc_id", *(count(k).alias(f"n_{KINDS[k]}") for k in range(4)), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def brute_force(documents: list[tuple]) -> dict:
    """doc_id -> (n_assign, n_access, n_hex, base_sha256), by the patterns alone."""
    out = {}
    for doc, text in documents:
        t = text or ""
        found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(t) if len(m[0]) >= 18]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        joined = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))
        out[doc] = (*(sum(k == i for _, k, _ in found) for i in range(3)), hashlib.sha256(joined.encode()).hexdigest())
    return out
