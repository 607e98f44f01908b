"""Toxicity scores over restored text: a noisy channel turns leetspeak, spaced letters and
repeated letters back into words, and a logistic model scores the words.

Channel: each character of a suspicious token becomes lattice edges (letters it may stand
for, nothing, or a word boundary), each with a cost; Viterbi decoding over the last two
letters picks the cheapest path under a character trigram model that is counted over all
documents. A run of tokens of one or two characters is one lattice, too: white space in it
is dropped or parts words, and words may part between letters. Digits of runs, and of
tokens without letters, may be numbers. Tokens whose lattice has a single path are taken
as they are.

The model's inputs are words of the restored text and their beginnings. Their counts come
from a sample of labelled documents of the training part, at most ``max_labels``, those of
the smallest hashes of doc_id. Every feature whose log-likelihood ratio for toxic texts
passes a fixed level of evidence is used, however many these are; the sample bounds them.
Everything else reads all documents.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.llm.common import drop_staged, lean, slices, staged, table
from barlab.llm.decontaminate import arrow_type

# Letters that a character may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
MARKS = ".-_*~^#,'/\\"  # may be dropped inside a word, or part two words
STRIP = ".,;:?\"'`()[]{}<>*#%&~=^/\\-_"
KINDS = 28  # boundary, a to z, any other letter
SPACED = re.compile(r"(?<!\S)\S{1,2}(?:\s+\S{1,2}){2,}(?!\S)")
ODD = re.compile(r"[0-9@$!|+(€£¡.\-_*~^#,'/\\]|(.)\1\1")
SLICE_BYTES, CACHE, CACHED_RUN = 2 << 20, 300_000, 100
COST = {"same": 0.0, "leet": 1.5, "drop": 1.0, "part": 2.5, "shorten": 0.5, "noise": 7.0, "number": 2.3}
NUMBER = "#"  # an edge's piece: a number, which is no word and parts words


def kind_of(ch: str) -> int:
    return ord(ch) - 96 if "a" <= ch <= "z" else 27


def lattice(token: str, spaced: bool):
    """The edges (piece, cost) of each run of equal characters."""
    numbers = spaced or not any(c.isalpha() for c in token)
    i, n = 0, len(token)
    while i < n:
        ch, j = token[i], i + 1
        space = ch.isspace()
        while j < n and (token[j].isspace() if space else token[j] == ch):
            j += 1
        run, edges = j - i, []
        if space:
            edges = [("", COST["drop"]), (" ", 0.0)]
        elif ch in MARKS:
            edges = [("", COST["drop"]), (" ", COST["part"])]
        elif ch in LEET:
            for letter in LEET[ch]:
                edges += [(letter * k, COST["leet"] * k + (COST["shorten"] if k < run else 0)) for k in range(1, min(run, 2) + 1)]
            edges += [("", COST["noise"] * run), (" ", COST["noise"] + COST["part"])]
            if numbers and ch.isdigit():
                edges.append((NUMBER, COST["number"] * run))
        else:
            edges = [(ch * k, COST["shorten"] if k < run else 0.0) for k in range(2 if run == 2 else 1, min(run, 2) + 1)]
        if spaced and j < n and not space and not token[j].isspace():
            edges += [(piece + " ", cost + COST["part"]) for piece, cost in edges if piece and piece not in (" ", NUMBER)]
        yield edges
        i = j


class CharModel:
    """Trigram model over letter kinds, smoothed by its bigrams and unigrams."""

    def __init__(self, counts: np.ndarray):
        tri = counts.reshape(KINDS, KINDS, KINDS).astype(float)
        one = tri.sum((0, 1)) + 1
        two = tri.sum(0)
        p1 = one / one.sum()
        p2 = (two + 5 * p1) / (two.sum(1, keepdims=True) + 5)
        p3 = (tri + 5 * p2) / (tri.sum(2, keepdims=True) + 5)
        self.cost = (-np.log(p3)).reshape(-1).tolist()

    def restore(self, token: str, spaced: bool = False) -> str:
        """The cheapest reading of a token, or of a run of short tokens (``spaced``); words
        in it are set apart by spaces."""
        paths: dict = {(0, 0): (0.0, None)}
        for edges in lattice(token, spaced):
            new: dict = {}
            for (x, y), (cost, out) in paths.items():
                for piece, extra in edges:
                    c, a, b = self.step(x, y, piece)
                    c += cost + extra
                    if (a, b) not in new or c < new[a, b][0]:
                        new[a, b] = (c, (out, " " if piece == NUMBER else piece))
            paths = new
        pieces, out = [], min((c + self.end(a, b), at) for at, ((a, b), (c, _)) in enumerate(paths.items()))[1]
        path = list(paths.values())[out][1]
        while path:
            path, piece = path
            pieces.append(piece)
        return "".join(reversed(pieces))

    def step(self, a: int, b: int, piece: str) -> tuple[float, int, int]:
        """What a piece costs after the last two letter kinds, and the last two after it."""
        if piece == NUMBER:
            return self.end(a, b), 0, 0
        cost = 0.0
        for letter in "" if piece == " " and not b else piece:  # words are apart already
            k = 0 if letter == " " else kind_of(letter)
            cost += self.cost[(a * KINDS + b) * KINDS + k]
            a, b = b, k
        return cost, a, b

    def end(self, a: int, b: int) -> float:
        return self.cost[(a * KINDS + b) * KINDS] if b else 0.0

    def words(self, token: bytes) -> list[str]:
        """Restored words of a lower-cased token."""
        text = token.decode("utf-8", "replace")
        text = re.sub(r"([$@!|+])\1{2,}$", "", text.strip(STRIP)).strip(STRIP).rstrip("!")
        if not text or not (ODD.search(text) or any(c.isalpha() for c in text)):
            return []
        return [w for w in self.restore(text).split() if any(c.isalpha() for c in w)] if ODD.search(text) else [text]

    def run_words(self, run: str) -> list[str]:
        """Restored words of a run of short lower-cased tokens."""
        return [w for w in self.restore(run, True).split() if any(c.isalpha() for c in w)]


def features(word: str) -> list[str]:
    return ["=" + word, *(word[:k] for k in range(3, min(len(word), 7) + 1))]


class Reader:
    """Features of texts; ``known`` maps those that count to their ids (None: all count)."""

    def __init__(self, model: CharModel, known: dict[str, int] | None = None):
        self.model, self.known, self.seen = model, known, {}

    def _token(self, token: bytes | str) -> tuple:
        """Features of a token, or of a run of tokens as text."""
        if len(self.seen) >= CACHE:
            self.seen.clear()
        words = self.model.run_words(token) if isinstance(token, str) else self.model.words(token)
        found = dict.fromkeys(f for w in words for f in features(w))
        out = tuple(found) if self.known is None else tuple(self.known[f] for f in found if f in self.known)
        if isinstance(token, bytes) or len(token) <= CACHED_RUN:
            self.seen[token] = out
        return out

    def __call__(self, text: bytes | None) -> set:
        text = (text or b"").lower()
        tokens: set = set(text.split())
        tokens.update(" ".join(m.group().split()) for m in SPACED.finditer(text.decode("utf-8", "replace")))
        get, out = self.seen.get, set()
        for t in tokens:
            f = get(t)
            if f is None:
                f = self._token(t)
            if f:
                out.update(f)
        return out


def _letter_counts(batches):
    fold = np.full(256, KINDS, np.int64)  # KINDS: not part of any trigram
    fold[[9, 10, 11, 12, 13, 32]] = 0
    fold[128:] = 27
    for b in range(97, 123):
        fold[b] = fold[b - 32] = b - 96
    total = np.zeros(KINDS**3, np.int64)
    for batch in batches:
        texts = batch.column(0).cast(pa.binary()).drop_null()
        for a, b in slices(pa.compute.binary_length(texts).to_pylist(), SLICE_BYTES):
            k = fold[np.frombuffer(b"  " + b"  ".join(texts[a:b].to_pylist()) + b"  ", np.uint8)]
            good = (k[:-2] < KINDS) & (k[1:-1] < KINDS) & (k[2:] < KINDS)
            code = (k[:-2] * KINDS + k[1:-1]) * KINDS + k[2:]
            total += np.bincount(code[good], minlength=KINDS**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["code", "n"])


def char_model(documents: DataFrame, text_col: str = "text") -> CharModel:
    """The trigram model of all texts; 28^3 counts reach the driver, whatever the input."""
    counts = documents.select(text_col).mapInArrow(lean(_letter_counts), "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    out = np.zeros(KINDS**3, np.int64)
    for row in counts.collect():
        out[row.code] = row.n
    return CharModel(out)


def _feature_counts(model):
    def run(batches):
        read, counts = Reader(model.value), {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, label in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist(), strict=True):
                counts[label].update(read(text.as_py()))
        for names in slices([1] * len(both := list(counts[0] | counts[1])), 50_000):
            part = both[names[0] : names[1]]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([counts[y][f] for f in part], pa.int64()) for y in (0, 1))], names=["feature", "clean", "toxic"])

    return run


def _vectors(reader):
    def run(batches):
        read = Reader(*reader.value)
        for batch in batches:
            rows = [sorted(read(t.as_py())) for t in batch.column(0).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows, pa.list_(pa.int64()))], names=["toxic", "ids"])

    return run


def fit_logistic(rows: list[list[int]], labels: np.ndarray, n: int, ridge: float = 1e-5, steps: int = 600) -> tuple[np.ndarray, float]:
    """Weights and bias by full gradient steps, each coordinate at its own pace."""
    flat = np.array([i for r in rows for i in r], np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, g2, b, b2 = np.zeros(n), np.full(n, 1e-8), 0.0, 1e-8
    balance = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9)) ** 0.5
    for _ in range(steps):
        z = b + np.bincount(owner, w[flat], len(rows))
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * balance
        g = np.bincount(flat, err[owner], n) / len(rows) + ridge * w
        g2, b2 = g2 + g * g, b2 + err.mean() ** 2
        w, b = w - 0.5 * g / np.sqrt(g2), b - 0.5 * err.mean() / np.sqrt(b2)
    return w, float(b)


class Scorer:
    def __init__(self, model: CharModel, known: dict[str, int], weights: np.ndarray, bias: float):
        self.model, self.known, self.weights, self.bias = model, known, weights, bias


def train(documents: DataFrame, labels: DataFrame, model: CharModel, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labels: int = 12_000, least: int = 3, evidence: float = 12.0) -> Scorer:
    """Fit on at most ``max_labels`` labelled documents. Of rows that repeat an id the
    largest label and the least text count, so that no id brings more than one text; rows
    without label, id or text do not count. Without both classes, the score of any text is
    the smoothed share of toxic rows."""
    spark = documents.sparkSession
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).filter("id is not null and toxic in (0, 1)")
    marks = marks.filter(F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0).groupBy("id").agg(F.max("toxic").alias("toxic"))
    marks = F.broadcast(marks.orderBy(F.xxhash64("id"), "id").limit(max_labels))  # at most max_labels small rows
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null").join(marks, "id")
    rows, rows_at = staged(rows.groupBy("id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic").repartition(24), "labelled")
    sizes = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    known: dict[str, int] = {}
    weights, bias = np.zeros(0), float(np.log((toxic + 0.5) / (clean + 0.5)))
    if toxic and clean:
        shared = spark.sparkContext.broadcast(model)
        counts = rows.mapInArrow(lean(_feature_counts(shared)), "feature string, clean bigint, toxic bigint").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
        best = counts.filter(F.col("toxic") >= least).withColumn("gain", odds * F.col("toxic")).filter((odds > 1.0) & (F.col("gain") > evidence))
        known = {r.feature: i for i, r in enumerate(best.orderBy(F.desc("gain"), "feature").select("feature").collect())}
        reader = spark.sparkContext.broadcast((model, known))
        data = rows.mapInArrow(lean(_vectors(reader)), "toxic int, ids array<bigint>").collect()  # at most max_labels short rows
        weights, bias = fit_logistic([r.ids for r in data], np.array([r.toxic for r in data], float), len(known))
        shared.destroy()
        reader.destroy()
    drop_staged(spark, rows_at)
    return Scorer(model, known, weights, bias)


def score(documents: DataFrame, scorer: Scorer, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for each row, repeated rows and null ids included; a null or empty
    text has the score of a text without any known feature."""
    shared = documents.sparkSession.sparkContext.broadcast(scorer)
    kind, id_type = documents.schema[id_col].dataType.simpleString(), arrow_type(documents, id_col)

    def run(batches):
        s = shared.value
        read = Reader(s.model, s.known)
        for batch in batches:
            z = [s.bias + s.weights[list(ids)].sum() if (ids := read(t.as_py())) else s.bias for t in batch.column(1).cast(pa.binary())]
            p = 1 / (1 + np.exp(-np.clip(np.array(z, float), -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], schema=pa.schema([("doc_id", id_type), ("score", pa.float64())]))

    return documents.select(F.col(id_col), F.col(text_col)).mapInArrow(lean(run), f"doc_id {kind}, score double")


def without_toxic(documents: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """The rows of ``documents`` whose text scores under ``limit``, with all their columns."""
    scorer = train(documents, labels, char_model(documents))
    shared = documents.sparkSession.sparkContext.broadcast(scorer)
    at = documents.columns.index("text")

    def run(batches):
        s = shared.value
        read = Reader(s.model, s.known)
        most = np.log(limit / (1 - limit)) - s.bias
        for batch in batches:
            keep = [s.weights[list(read(t.as_py()))].sum() < most for t in batch.column(at).cast(pa.binary())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(lean(run), documents.schema)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    documents = table(spark, sf_dir, "documents")
    scorer = train(documents, table(spark, sf_dir, "labels"), char_model(documents))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return score(documents, scorer).select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
