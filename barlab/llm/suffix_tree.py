"""Scores of a probabilistic suffix tree, beside those of a word unigram model.

The tree's symbols are the bytes of a text's lower-cased words, joined by single spaces,
and one end symbol, a byte that UTF-8 never has. Its states are contexts of up to ``depth``
symbols. A context stays when the divergence of its next-symbol distribution from its
suffix's, times its count, reaches ``divergence`` nats, or when a longer context that stays
has it as suffix. Each distribution is interpolated with its suffix's, so every state gives
proper probabilities. A symbol is scored by the longest suffix state of what stands before.

Counting is distributed: tasks count the (context, symbol) grams of bounded slices and deal
them to buckets by the four symbols before the predicted one, those of three and of two
symbols apart. One shuffle brings the grams of a bucket together, where they are added up
and packed by these symbols. Contexts of two
symbols and fewer (65,793 at most) are treated on the driver, those of three each by its
own, and all longer ones that end in the same four symbols, a branch of the tree, by numpy,
some branches at a time. A branch of contexts of six symbols has 256^3 grams at most, so no
task holds more, however common its symbols. The tree is a staged table of any size, a row
for each state. Its commonest states, of at most ``head_entries`` entries, are sent to the
tasks, with marks where the tree goes on beyond them. Grams that go on there are asked for:
the distinct ones of each run of texts travel, packed, to buckets of branches, as many as
keep a bucket's part of the tree small, and their scores travel back to the run, so no gram
is sent once for each of its occurrences.
Words are treated in the same way: the commonest, ``head`` at most, are sent to the tasks,
the others of each text meet their counts in a shuffle join.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.llm.common import drop_staged, free_shuffles, lean, slices, staged, table
from barlab.llm.decontaminate import arrow_type

DEPTH, BETA, END = 6, 4.0, b" "  # the usual depth; a symbol and seven before it fill 64 bits
LOW, BRANCH = 2, 4  # contexts up to LOW symbols are treated on the driver, a branch has BRANCH
STOP = b"\xff"  # the end symbol, and what stands before a text
GRAM_BYTES, SLICE_BYTES, TABLE_BITS = 2 << 20, 1 << 20, 22
GRAMS_HELD, WORDS_HELD, BRANCH_GRAMS, BUCKET_ENTRIES, LEAST_BUCKETS = 1_500_000, 400_000, 400_000, 500_000, 1024
PRIME = 1_000_003  # spreads keys over buckets
MASK = [(1 << 8 * k) - 1 for k in range(8)] + [-1]  # as signed 64-bit numbers


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()  # ASCII case and ASCII white space only


def grams(texts: list[list[bytes]], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Codes of each symbol with the ``depth`` before it, and how many codes each text has."""
    bodies = [b" ".join(w) + STOP for w in texts]
    lengths = np.array([len(b) for b in bodies], np.int64)
    raw = np.frombuffer(STOP * depth + (STOP * depth).join(bodies), np.uint8).astype(np.int64)
    code = raw[depth:].copy()
    for k in range(1, depth + 1):
        code |= raw[depth - k : len(raw) - k] << (8 * k)
    between = np.cumsum(lengths + depth)[:-1, None] - depth + np.arange(depth)
    return np.delete(code, between.reshape(-1)), lengths


def _slices(batch, limit: int):
    texts = batch.column(0).cast(pa.binary())
    for a, b in slices(pa.compute.binary_length(texts).fill_null(0).to_pylist(), limit):
        yield a, b, texts[a:b].to_pylist()


def _turned(code: np.ndarray) -> np.ndarray:
    """Codes with the four symbols before the predicted one as the highest bytes, so that
    sorting brings branches together; ``_turned_back`` undoes it."""
    c = code.view(np.uint64)
    return (c >> np.uint64(8)) << np.uint64(32) | c >> np.uint64(40) << np.uint64(8) | c & np.uint64(0xFF)


def _turned_back(t: np.ndarray) -> np.ndarray:
    return ((t >> np.uint64(8)) << np.uint64(40) | t >> np.uint64(32) << np.uint64(8) | t & np.uint64(0xFF)).view(np.int64)


def summed(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and the sums of their counts."""
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])[: len(code)])
    return code[first], np.add.reduceat(n, first) if len(first) else n


class Sums:
    """Counts by code, added up in parts; ``all`` gives their sums."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, code: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((code, n))
        self.held += len(code)
        if len(self.parts) > 1 and self.held > 2 * max(GRAMS_HELD, len(self.parts[0][0])):
            self.all()

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) > 1:
            self.parts = [summed(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))]
            self.held = len(self.parts[0][0])
        return self.parts[0] if self.parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


#: Bytes of a pack's codes: the key of a pack of short contexts is the whole context, that of
#: a branch leaves up to three symbols and the predicted one.
CODE_BYTES = {LOW: 1, LOW + 1: 1, BRANCH: 4}


def _planes(x: np.ndarray, size: int) -> bytes:
    """The lowest bytes of numbers, byte by byte, highest first."""
    return x.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - size :].T.tobytes()


def _numbers(planes: np.ndarray) -> np.ndarray:
    out = np.zeros(planes.shape[1], np.uint64)
    for plane in planes:
        out = out << np.uint64(8) | plane
    return out


def _packed(level: int, code: np.ndarray, n: np.ndarray) -> bytes:
    """Codes and counts: how many bytes the largest count takes, then both in planes."""
    size = max(1, (int(n.max(initial=0)).bit_length() + 7) // 8)
    return bytes([size]) + _planes(code, CODE_BYTES[level]) + _planes(n.astype(np.uint64), size)


def _unpacked(level: int, key: int, body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Whole codes and counts of a pack, those of a branch turned."""
    width = CODE_BYTES[level]
    planes = np.frombuffer(body, np.uint8, offset=1).reshape(width + body[0], -1).astype(np.uint64)
    return np.uint64(key << 8 * width) | _numbers(planes[:width]), _numbers(planes[width:]).astype(np.int64)


def _packs(level: int, code: np.ndarray, n: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Rows (level, key, body) of codes in order."""
    key = code >> np.uint64(8 * CODE_BYTES[level])
    edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(code) else np.zeros(0, np.int64)
    return [(level, int(key[i]), _packed(level, code[i:j], n[i:j])) for i, j in pairwise(edges.tolist())]


def _pack_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["level", "key", "body"])


def _dealt(level: int, code: np.ndarray, n: np.ndarray, buckets: int) -> list[tuple[int, int, bytes]]:
    """Rows (level, bucket, body) of codes in order: the codes of each bucket of keys, by the
    steps from one to the next, and their counts."""
    bucket = (code >> np.uint64(8 * CODE_BYTES[level]) & np.uint64(MASK[BRANCH])) % np.uint64(PRIME) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    code, n, bucket = code[order], n[order], bucket[order]
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(code) else np.zeros(0, np.int64)
    out = []
    for i, j in pairwise(edges.tolist()):
        size = max(1, (int(n[i:j].max()).bit_length() + 7) // 8)
        out.append((level, int(bucket[i]), bytes([size]) + _planes(np.diff(code[i:j], prepend=np.uint64(0)), 8) + _planes(n[i:j].astype(np.uint64), size)))
    return out


def _gathered(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The codes and counts of a row of a bucket."""
    planes = np.frombuffer(body, np.uint8, offset=1).reshape(8 + body[0], -1).astype(np.uint64)
    return np.cumsum(_numbers(planes[:8]), dtype=np.uint64), _numbers(planes[8:]).astype(np.int64)


def _gram_rows(code: np.ndarray, n: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Rows of sorted turned codes, and of their grams of three and of LOW symbols."""
    three, m3 = summed((code >> np.uint64(32) & np.uint64(0xFFFFFF)) << np.uint64(8) | code & np.uint64(0xFF), n)
    low, m2 = summed(three & np.uint64(0xFFFFFF), m3)
    return _pack_batch([*_dealt(BRANCH, code, n, buckets), *_dealt(LOW + 1, three, m3, buckets), *_dealt(LOW, low, m2, buckets)])


def _count_grams(depth: int, buckets: int):
    def run(batches):
        held = Sums()
        for batch in batches:
            for _, _, texts in _slices(batch, GRAM_BYTES):
                held.add(*np.unique(_turned(grams([words(t) for t in texts], depth)[0]), return_counts=True))
                if held.held > GRAMS_HELD and len(held.all()[0]) > GRAMS_HELD:
                    yield _gram_rows(*held.all(), buckets)
                    held = Sums()
        yield _gram_rows(*held.all(), buckets)

    return run


def _merged(batches):
    """A pack for each key of a bucket, with the sums of the bucket's rows, which come together."""
    now, held = None, Sums()
    for batch in batches:
        for level, bucket, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if (level, bucket) != now:
                if now is not None:
                    yield _pack_batch(_packs(now[0], *held.all()))
                now, held = (level, bucket), Sums()
            code, n = _gathered(body.as_py())
            held.add(code, n)
    if now is not None:
        yield _pack_batch(_packs(now[0], *held.all()))


def _short_counts(level: int):
    """(code, n) of packs (level, key, body) of short contexts."""

    def run(batches):
        for batch in batches:
            parts = [_unpacked(level, key, body.as_py()) for key, body in zip(batch.column(1).to_pylist(), batch.column(2), strict=True)]
            if parts:
                code, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(n)], names=["code", "n"])

    return run


class Level:
    """Grams of contexts of k symbols: codes in order, counts, contexts, smoothed
    probabilities, and which contexts stay."""

    def __init__(self, k: int, code: np.ndarray, n: np.ndarray, parent: Level | None, divergence: float):
        self.k, self.code, self.n = k, code, n
        self.ctx, self.first, self.of = np.unique((code >> 8) & MASK[k], return_index=True, return_inverse=True)
        self.total = np.bincount(self.of, n, len(self.ctx))
        if parent is None:
            self.p, self.stays = (n + 1) / (n.sum() + 256), np.ones(len(self.ctx), bool)
            return
        below = parent.p[np.searchsorted(parent.code, code & MASK[k])]
        self.p = (n + BETA * below) / (self.total[self.of] + BETA)
        self.stays = np.bincount(self.of, n * np.log(self.p / below), len(self.ctx)) >= divergence

    def keep(self, longer: np.ndarray) -> None:
        """Contexts that longer ones which stay have as suffix stay, too."""
        self.stays[np.searchsorted(self.ctx, np.unique(longer & MASK[self.k]))] = True

    def states(self, every: bool = False) -> pa.RecordBatch:
        """The states that stay, or all with a mark of whether they do."""
        kept = np.ones(len(self.ctx), bool) if every else self.stays
        size = np.bincount(self.of, minlength=len(self.ctx))[kept]
        entry = kept[self.of]
        stops = pa.array(np.append(0, np.cumsum(size)), pa.int32())
        symbols, v = pa.array(self.code[entry] & 0xFF, pa.int16()), pa.array(np.log10(self.p[entry]))
        columns = [
            pa.array(np.full(len(size), self.k, np.int32)), pa.array(self.ctx[kept]), pa.array(self.total[kept].astype(np.int64)),
            pa.ListArray.from_arrays(stops, symbols), pa.ListArray.from_arrays(stops, v),
        ]
        return pa.RecordBatch.from_arrays([*columns, pa.array(self.stays)], names=[*COLUMNS, "stays"]) if every else pa.RecordBatch.from_arrays(columns, names=COLUMNS)


def _shorter(code: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    return summed(code & MASK[k + 1], n)


COLUMNS = ["k", "ctx", "total", "symbols", "v"]
STATES = "k int, ctx bigint, total bigint, symbols array<smallint>, v array<double>"


def _ordered(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of packs in order, as whole numbers; packs that come twice count once."""
    code, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    code, at = np.unique(code.view(np.int64), return_index=True)
    return code, n[at]


def _grow_three(low, divergence: float):
    """All states of three symbols, with marks of those that stay by themselves."""

    def run(batches):
        for batch in batches:
            for a in range(0, len(batch), 4096):
                part = batch.slice(a, 4096)
                parts = [_unpacked(LOW + 1, key, body.as_py()) for key, body in zip(part.column(1).to_pylist(), part.column(2), strict=True)]
                yield Level(LOW + 1, *_ordered(parts), low.value, divergence).states(every=True)

    return run


def _grow(low, depth: int, divergence: float):
    """States of more than three symbols, from branches (key, body) with the packs of their
    contexts of three symbols (three)."""

    def grown(branches, threes) -> Iterator[pa.RecordBatch]:
        turned, n = (np.concatenate(x) for x in zip(*branches, strict=True))
        code, n = summed(_turned_back(turned).view(np.uint64), n)  # in the order of their contexts, also where these fill seven bytes
        counts = {depth: (code.view(np.int64), n)}
        for k in range(depth - 1, LOW + 1, -1):
            counts[k] = _shorter(*counts[k + 1], k)
        levels = [Level(LOW + 1, *_ordered([_unpacked(LOW + 1, key, body) for key, body in threes.items()]), low.value, divergence)]
        for k in range(LOW + 2, depth + 1):
            levels.append(Level(k, *counts[k], levels[-1], divergence))
        for level, longer in zip(levels[-2:0:-1], levels[:1:-1], strict=True):
            level.keep(longer.ctx[longer.stays])
        for level in levels[1:]:
            yield level.states()

    def run(batches):
        branches, threes, held = [], {}, 0
        for batch in batches:
            for key, body, three in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                branches.append(_unpacked(BRANCH, key, body.as_py()))
                threes[key & MASK[LOW + 1]] = three.as_py()
                held += len(branches[-1][0])
                if held > BRANCH_GRAMS:
                    yield from grown(branches, threes)
                    branches, threes, held = [], {}, 0
        if branches:
            yield from grown(branches, threes)

    return run


def _count_words(batches):
    held: Counter = Counter()

    def part() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    for batch in batches:
        for _, _, texts in _slices(batch, SLICE_BYTES):
            for t in texts:
                held.update(words(t))
            held[END] += len(texts)
            if len(held) > WORDS_HELD:
                yield part()
                held.clear()
    yield part()


class Head:
    """The commonest states and their distributions in sorted arrays, one set for each
    length of contexts. ``more`` marks, for each state, the 256 symbols before it by which
    it is lengthened to a state that is not here."""

    def __init__(self, states: pa.Table):
        """From rows (k, ctx, total, symbols, v, more0, more1, more2, more3)."""
        self.entries, self.states = [], []
        self.depth = max(pa.compute.max(states["k"]).as_py() or 0, LOW) + 1
        for k in range(self.depth):
            level = states.filter(pa.compute.equal(states["k"], k)).combine_chunks()
            ctx = level["ctx"].to_numpy()
            size = pa.compute.list_value_length(level["symbols"]).to_numpy()
            gram = np.repeat(ctx, size) << 8 | pa.compute.list_flatten(level["symbols"]).to_numpy().astype(np.int64)
            entry, state = np.argsort(gram), np.argsort(ctx)
            self.entries.append((gram[entry], pa.compute.list_flatten(level["v"]).to_numpy()[entry]))
            back = np.log10(BETA / (level["total"].to_numpy() + BETA)) if k else np.zeros(len(ctx))
            more = np.stack([level[f"more{q}"].to_numpy() for q in range(4)], 1)
            self.states.append((ctx[state], back[state], more[state]))

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def walk(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each code, its longest suffix state here: log10 probability of the symbol
        after it, its length, and whether the tree has a longer one."""
        out, depth = np.zeros(len(code)), np.full(len(code), -1)
        done, longer = np.zeros(len(code), bool), np.zeros(len(code), bool)
        for k in range(self.depth - 1, -1, -1):
            keys, back, more = self.states[k]
            at, state = self._find(keys, (code >> 8) & MASK[k])
            new = np.flatnonzero(state & (depth < 0))
            depth[new] = k
            if k < 7:
                before = (code[new] >> (8 * k + 8)) & 255
                longer[new] = (more[at[new], before >> 6] >> (before & 63)) & 1 == 1
            live = np.flatnonzero((depth >= 0) & ~done)
            e, found = self._find(self.entries[k][0], code[live] & MASK[k + 1])
            out[live[found]] += self.entries[k][1][e[found]]
            out[live[~found]] += back[at[live[~found]]]
            done[live[found]] = True
        return out, depth, longer

    def score(self, code: np.ndarray) -> np.ndarray:
        """log10 probabilities; not a number where the longest state is not here."""
        out, _, longer = self.walk(code)
        return np.where(longer, np.nan, out)


class Part:
    """Some branches' states that are not in the head."""

    def __init__(self, head: Head, states: list[pa.RecordBatch]):
        """From rows of COLUMNS; a state may come more than once."""
        self.head, self.levels = head, {}
        table = pa.Table.from_batches(states).combine_chunks() if states else None
        ks = table["k"].to_numpy() if states else np.zeros(0, np.int64)
        for k in np.unique(ks).tolist():
            rows = np.flatnonzero(ks == k)
            rows = rows[np.unique(table["ctx"].to_numpy()[rows], return_index=True)[1]]
            part = table.take(pa.array(rows)).combine_chunks()
            ctx, symbols = part["ctx"].to_numpy(), part["symbols"]
            gram = np.repeat(ctx, pa.compute.list_value_length(symbols).to_numpy()) << 8 | pa.compute.list_flatten(symbols).to_numpy().astype(np.int64)
            entry = np.argsort(gram)
            self.levels[k] = (ctx, np.log10(BETA / (part["total"].to_numpy() + BETA)), gram[entry], pa.compute.list_flatten(part["v"]).to_numpy()[entry])

    def score(self, code: np.ndarray) -> np.ndarray:
        """log10 probabilities by the longest suffix state, here or in the head. No state here
        is as common as those of the head, so longer ones are only here."""
        out, depth, _ = self.head.walk(code)
        for k, (ctx, back, gram, v) in self.levels.items():
            at, state = Head._find(ctx, (code >> 8) & MASK[k])
            rows = np.flatnonzero(state & (depth < k))
            e, known = Head._find(gram, code[rows] & MASK[k + 1])
            out[rows] = np.where(known, v[e] if len(v) else 0.0, out[rows] + back[at[rows]])
        return out


def _bucket(ctx: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of contexts, by their last BRANCH symbols."""
    return (ctx & MASK[BRANCH]) % PRIME % buckets


def asked(codes: np.ndarray, chunk: int, buckets: int) -> list[tuple[int, int, bytes, list[int]]]:
    """Rows (bucket, chunk, body, threes) of distinct codes: the codes of each bucket in
    order, and their contexts of three symbols."""
    bucket = _bucket(codes >> 8, buckets)
    order = np.lexsort((codes, bucket))
    codes, bucket = codes[order], bucket[order]
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(codes) else np.zeros(0, np.int64)
    return [(int(bucket[i]), chunk, _planes(codes[i:j].view(np.uint64), 8), np.unique((codes[i:j] >> 8) & MASK[LOW + 1]).tolist()) for i, j in pairwise(edges.tolist())]


def _codes(body: bytes) -> np.ndarray:
    return _numbers(np.frombuffer(body, np.uint8).reshape(8, -1).astype(np.uint64)).view(np.int64)


ASKED = "bucket int, chunk bigint, body binary, threes array<bigint>"


class Tree:
    """A suffix tree: its head, and the table of the states (k, ctx, total, symbols, v) that
    are not in the head, in so many buckets. The states are read from staged tables at paths."""

    def __init__(self, head: Head, states: DataFrame, buckets: int, depth: int, paths: tuple[str, ...] = ()):
        self.head, self.states, self.buckets, self.depth, self.paths = head, states, buckets, depth, paths

    def answers(self, requests: DataFrame) -> DataFrame:
        """(bucket, chunk, body, v) of requests (bucket, chunk, body, threes): v has the log10
        probability of each code of the body, as 8-byte floats. A bucket gets the longer
        states of its branches, and those of three symbols that its requests name."""
        shared = requests.sparkSession.sparkContext.broadcast(self.head)
        own = self.states.filter(F.col("k") >= BRANCH).withColumn("bucket", (F.col("ctx").bitwiseAND(F.lit(MASK[BRANCH])) % PRIME % self.buckets).cast("int"))
        named = requests.select("bucket", F.explode("threes").alias("ctx")).distinct()
        short = self.states.filter(F.col("k") == LOW + 1).join(named, "ctx").select("bucket", *COLUMNS)
        null = lambda kind, name: F.lit(None).cast(kind).alias(name)
        kinds = dict(self.states.dtypes)
        rows = own.select("bucket", *COLUMNS).unionByName(short).select("bucket", F.lit(0).alias("kind"), null("bigint", "chunk"), null("binary", "body"), *COLUMNS)
        rows = rows.unionByName(requests.select("bucket", F.lit(1).alias("kind"), "chunk", "body", *(null(kinds[c], c) for c in COLUMNS)))

        def run(batches):
            now, states, part = None, [], None
            for batch in batches:
                buckets, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                cuts = np.flatnonzero((buckets[1:] != buckets[:-1]) | (kinds[1:] != kinds[:-1])) + 1
                for a, b in pairwise([0, *cuts.tolist(), len(buckets)] if len(buckets) else []):
                    if buckets[a] != now:
                        now, states, part = buckets[a], [], None
                    rows = batch.slice(a, b - a)
                    if kinds[a] == 0:
                        states.append(rows.select(COLUMNS))
                        continue
                    if part is None:
                        part, states = Part(shared.value, states), []
                    bodies = [_codes(body.as_py()) for body in rows.column(3)]
                    v = np.split(part.score(np.concatenate(bodies)), np.cumsum([len(x) for x in bodies])[:-1])
                    yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), rows.column(3), pa.array([x.tobytes() for x in v], pa.binary())], names=["bucket", "chunk", "body", "v"])

        return rows.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(lean(run), "bucket int, chunk bigint, body binary, v binary")

    def score(self, code: np.ndarray) -> np.ndarray:
        """log10 probability of each code's symbol after its longest suffix state."""
        out = self.head.score(code)
        far = np.isnan(out)
        if far.any():
            wanted = np.unique(code[far])
            rows = self.answers(self.states.sparkSession.createDataFrame(asked(wanted, 0, self.buckets), ASKED)).collect()
            codes, v = np.concatenate([_codes(bytes(r.body)) for r in rows]), np.frombuffer(b"".join(r.v for r in rows))
            order = np.argsort(codes)
            out[far] = v[order][np.searchsorted(codes[order], code[far])]
        return out


def _summed_answers(batches):
    """(row, far_score) of texts (chunk, kind 1, row, grams) behind the answers (chunk, kind
    0, body, v) to their chunk."""
    now, codes, v, known = None, [], [], None
    for batch in batches:
        chunks, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero((chunks[1:] != chunks[:-1]) | (kinds[1:] != kinds[:-1])) + 1
        for a, b in pairwise([0, *cuts.tolist(), len(chunks)] if len(chunks) else []):
            if chunks[a] != now:
                now, codes, v, known = chunks[a], [], [], None
            part = batch.slice(a, b - a)
            if kinds[a] == 0:
                codes += [_codes(body.as_py()) for body in part.column(2)]
                v += [np.frombuffer(value.as_py()) for value in part.column(3)]
                continue
            if known is None:
                known = (np.concatenate(codes), np.concatenate(v))
                order, codes, v = np.argsort(known[0]), [], []
                known = (known[0][order], known[1][order])
            grams_ = part.column(5)
            flat, size = pa.compute.list_flatten(grams_).to_numpy(), pa.compute.list_value_length(grams_).to_numpy()
            total = np.append(0.0, np.cumsum(known[1][np.searchsorted(known[0], flat)]))
            stop = np.cumsum(size)
            yield pa.RecordBatch.from_arrays([part.column(4), pa.array(total[stop] - total[stop - size])], names=["row", "far_score"])


class Cached:
    """A head's scores, remembered in a table of fixed size by gram."""

    def __init__(self, head: Head):
        self.head = head
        self.key, self.value = np.full(1 << TABLE_BITS, -1, np.int64), np.zeros(1 << TABLE_BITS)

    def __call__(self, code: np.ndarray) -> np.ndarray:
        slot = ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        out = self.value[slot]
        miss = np.flatnonzero((self.key[slot] != code) | (code == -1))  # -1 is a code, too
        if len(miss):
            new, at = np.unique(code[miss], return_inverse=True)
            value = self.head.score(new)
            out[miss] = value[at]
            self.key[slot[miss]], self.value[slot[miss]] = code[miss], out[miss]
        return out


def build_tree(texts: DataFrame, *, depth: int = DEPTH, divergence: float = 12.0, head_entries: int = 2_000_000) -> Tree:
    """The tree of a one-column frame of texts; without any text, all symbols are as likely.
    Its head has the states of LOW symbols and fewer and, up to ``head_entries``, those of
    the largest counts, as quarter powers of two. ``depth`` is from 4 to 7."""
    if not BRANCH <= depth <= 7:
        raise ValueError("contexts have 4 to 7 symbols at most")
    spark = texts.sparkSession
    pack = "level int, key bigint, body binary"
    buckets = max(LEAST_BUCKETS, 16 * int(spark.conf.get("spark.sql.shuffle.partitions")))  # a task has some of them, one at a time
    packed = texts.mapInArrow(lean(_count_grams(depth, buckets)), pack).repartition("level", "key").sortWithinPartitions("level", "key")
    grams_, grams_at = staged(packed.mapInArrow(lean(_merged), pack), "grams")
    free_shuffles(spark)
    found = grams_.filter(F.col("level") == LOW).mapInArrow(lean(_short_counts(LOW)), "code bigint, n bigint").toArrow()  # 256^3 rows at most
    order = np.argsort(found["code"].to_numpy())
    counts = {LOW: (found["code"].to_numpy()[order], found["n"].to_numpy()[order])}
    for k in range(LOW - 1, -1, -1):
        counts[k] = _shorter(*counts[k + 1], k)
    low: list[Level] = []
    for k in range(LOW + 1):
        low.append(Level(k, *counts[k], low[-1] if low else None, divergence))
    shared = spark.sparkContext.broadcast(low[LOW])
    threes = grams_.filter(F.col("level") == LOW + 1)
    branches = grams_.filter(F.col("level") == BRANCH).withColumn("short", F.col("key").bitwiseAND(F.lit(MASK[LOW + 1])))
    branches = branches.join(threes.select(F.col("key").alias("short"), F.col("body").alias("three")), "short").select("key", "body", "three")
    long, long_at = staged(branches.mapInArrow(lean(_grow(shared, depth, divergence)), STATES), "tree", "zstd")
    continued = long.filter(F.col("k") == BRANCH).select(F.col("ctx").bitwiseAND(F.lit(MASK[LOW + 1])).alias("ctx")).distinct()
    three = threes.mapInArrow(lean(_grow_three(shared, divergence)), f"{STATES}, stays boolean").join(continued.withColumn("longer", F.lit(True)), "ctx", "left")
    short, short_at = staged(three.filter("stays or longer").select(*COLUMNS), "tree", "zstd")
    tree = long.unionByName(short)
    shared.destroy()
    drop_staged(spark, grams_at)
    free_shuffles(spark)

    lengthened = short.select(F.col("ctx").bitwiseAND(F.lit(MASK[LOW])).alias("ctx")).distinct().toArrow()  # 256^LOW rows at most
    low[LOW].keep(lengthened["ctx"].to_numpy())
    for level, longer in zip(low[LOW - 1 :: -1], low[:0:-1], strict=True):
        level.keep(longer.ctx[longer.stays])
    total = int(low[0].n.sum())
    base = np.full(256, math.log10(1 / (total + 256)))  # of any symbol, also of those that no text has
    base[low[0].code] = np.log10(low[0].p)
    root = pa.table({"k": pa.array([0], pa.int32()), "ctx": [0], "total": [total], "symbols": pa.array([range(256)], pa.list_(pa.int16())), "v": [base.tolist()]})

    step = F.floor(F.log2("total") * 4)
    sizes = {r.step: r.m for r in tree.groupBy(step.alias("step")).agg(F.sum(F.size("symbols")).alias("m")).collect()}  # a few hundred rows
    least, held = max(sizes, default=0) + 1, sum(int(x.stays[x.of].sum()) for x in low)
    while least > 0 and held + sizes.get(least - 1, 0) <= head_entries:
        least -= 1
        held += sizes.get(least, 0)
    far = tree.filter(step < least)
    before = F.expr("shiftright(ctx, 8 * (k - 1)) & 255")
    marks = [F.bit_or(F.when(F.shiftright(before, 6) == q, F.expr("shiftleft(1L, cast((shiftright(ctx, 8 * (k - 1)) & 63) as int))")).otherwise(F.lit(0).cast("bigint"))).alias(f"more{q}") for q in range(4)]
    more = far.groupBy((F.col("k") - 1).alias("k"), F.expr("ctx & (shiftleft(1L, 8 * (k - 1)) - 1)").alias("ctx")).agg(*marks)
    near = tree.filter(step >= least).unionByName(spark.createDataFrame(pa.concat_tables([root, *(pa.Table.from_batches([x.states()]) for x in low[1:])]), STATES))
    head = near.join(more, ["k", "ctx"], "left").na.fill(0, [f"more{q}" for q in range(4)]).toArrow()  # head_entries entries at most
    buckets = max(16, -(-sum(m for k, m in sizes.items() if k < least) // BUCKET_ENTRIES))
    return Tree(Head(head), far, buckets, depth, (long_at, short_at))


def common_words(counts: DataFrame, head: int) -> dict[bytes, float]:
    """log10(count + 0.1) of the commonest words: of all counts from the least quarter power
    of two that at most ``head`` words reach; the end token in any case."""
    step = F.floor(F.log2("n") * 4)
    sizes = {r.step: r["count"] for r in counts.groupBy(step.alias("step")).count().collect()}  # a few hundred rows
    low, kept = max(sizes, default=0) + 1, 0
    while low > 0 and kept + sizes.get(low - 1, 0) <= head:
        low -= 1
        kept += sizes.get(low, 0)
    rows = counts.filter((step >= low) | (F.col("word") == F.lit(bytearray(END)))).toLocalIterator()
    return {bytes(r.word): math.log10(r.n + 0.1) for r in rows}


def score_texts(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, head: int = 80_000, **tree) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row.

    Rows whose crc32 of the id as text is a multiple of ``folds`` are held out; the others
    train both models, those of a null id among them. Null and empty texts have the end
    token only. Repeated rows count and are returned as often as they occur.
    """
    spark, id_type = documents.sparkSession, arrow_type(documents, id_col)
    kind = documents.schema[id_col].dataType.simpleString()
    docs = documents.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"), F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False)).alias("held_out"))
    train = docs.filter("not held_out").select("text")
    counts, counts_at = staged(train.mapInArrow(lean(_count_words), "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 0"), "words")
    size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("distinct")).first()
    model = build_tree(train, **tree)
    shared = spark.sparkContext.broadcast((model.head, common_words(counts, head)))
    kinds = [("chunk", pa.int64()), ("bucket", pa.int32()), ("body", pa.binary()), ("threes", pa.list_(pa.int64()))]
    depth, buckets = model.depth, model.buckets
    schema = pa.schema([("doc_id", id_type), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_head", pa.int64()), ("head_score", pa.float64()), ("score", pa.float64()), ("tail", pa.list_(pa.binary())), ("times", pa.list_(pa.int32())), ("grams", pa.list_(pa.int64())), *kinds])
    none = math.log10(0.1)

    def run(batches):
        tree, known = shared.value
        tree, get = Cached(tree), known.get
        chunk, wanted = TaskContext.get().partitionId() << 24, Sums()

        def requests() -> pa.RecordBatch:
            rows = asked(wanted.all()[0], chunk, buckets)
            nulls = [pa.nulls(len(rows), f.type) for f in schema][:9]
            return pa.RecordBatch.from_arrays([*nulls, *(pa.array([r[i] for r in rows], t) for i, (_, t) in zip((1, 0, 2, 3), kinds, strict=True))], schema=schema)

        for batch in batches:
            for a, b, texts in _slices(batch, SLICE_BYTES):
                tokens = [words(t) for t in texts]
                code, lengths = grams(tokens, depth)
                logs, starts = tree(code), np.cumsum(lengths) - lengths
                far = np.isnan(logs)
                score = np.add.reduceat(np.where(far, 0.0, logs), starts)
                bounds = np.append(0, np.cumsum(np.add.reduceat(far.astype(np.int64), starts)))
                far = code[far]
                new = np.unique(far)
                wanted.add(new, np.ones(len(new), np.int64))
                tails, times, heads, sums = [], [], [], []
                for t in tokens:
                    logs = [get(w) for w in t]
                    tail = [w for w, v in zip(t, logs, strict=True) if v is None]
                    rare = Counter(tail)
                    tails.append(list(rare))
                    times.append(list(rare.values()))
                    end = get(END)
                    heads.append(len(t) - len(tail) + (end is not None))
                    sums.append(math.fsum(v for v in logs if v is not None) + (none if end is None else end))
                yield pa.RecordBatch.from_arrays([
                    batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array([len(t) + 1 for t in tokens], pa.int64()),
                    pa.array(heads, pa.int64()), pa.array(sums, pa.float64()), pa.array(score), pa.array(tails, schema.field("tail").type), pa.array(times, schema.field("times").type),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(far)),
                    pa.array([chunk] * (b - a), pa.int64()), *(pa.nulls(b - a, t) for _, t in kinds[1:]),
                ], schema=schema)
                if wanted.held > GRAMS_HELD and len(wanted.all()[0]) > GRAMS_HELD:
                    yield requests()
                    chunk, wanted = chunk + 1, Sums()
        yield requests()

    scored = docs.mapInArrow(lean(run), f"doc_id {kind}, held_out boolean, n_tokens bigint, n_head bigint, head_score double, score double, tail array<binary>, times array<int>, grams array<bigint>, chunk bigint, bucket int, body binary, threes array<bigint>")
    everything, everything_at = staged(scored.withColumn("row", F.monotonically_increasing_id()), "scored", "zstd")
    free_shuffles(spark)
    scored = everything.filter("bucket is null")
    answers = model.answers(everything.filter("bucket is not null").select("bucket", "chunk", "body", "threes"))
    null = lambda kind: F.lit(None).cast(kind)
    rows = answers.select("chunk", F.lit(0).alias("kind"), "body", "v", null("bigint").alias("row"), null("array<bigint>").alias("grams"))
    rows = rows.unionByName(scored.filter(F.size("grams") > 0).select("chunk", F.lit(1).alias("kind"), null("binary").alias("body"), null("binary").alias("v"), "row", "grams"))
    far, _ = staged(rows.repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(lean(_summed_answers), "row bigint, far_score double"), "far")
    drop_staged(spark, *model.paths)
    free_shuffles(spark)
    tail = scored.select("row", F.explode(F.arrays_zip("tail", "times")).alias("t")).select("row", F.col("t.tail").alias("word"), F.col("t.times").alias("m"))
    tail = tail.join(counts, "word", "left").groupBy("row").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("m")).otherwise(0)).alias("n_tail"), F.sum(F.col("m") * F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("tail_score"))
    tail, _ = staged(tail, "tail")
    drop_staged(spark, counts_at)
    free_shuffles(spark)
    out = scored.drop("tail", "times", "grams", "chunk", "bucket", "body", "threes").join(tail, "row", "left").join(far, "row", "left")
    spread = math.log10(size.total + 0.1 * (size.distinct + 1))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_head") + F.coalesce("n_tail", F.lit(0))).alias("n_known"), F.lit(size.total).cast("bigint").alias("train_tokens"),
        (F.col("head_score") + F.coalesce("tail_score", F.lit(0.0)) - F.col("n_tokens") * spread).alias("base_score"),
        (F.col("score") + F.coalesce("far_score", F.lit(0.0))).alias("score"),
    )


def op6_suffix_tree(spark, sf_dir: str) -> DataFrame:
    """Both models' scores of each document."""
    return score_texts(table(spark, sf_dir, "documents"))


def brute_force(documents: list[tuple], folds: int = 10) -> dict:
    """doc_id -> (held_out, n_tokens, n_known, train_tokens, base_score), for small tests."""
    from zlib import crc32

    tokens = {d: [*words(t and t.encode()), END] for d, t in documents}
    out = {d: crc32(str(d).encode()) % folds == 0 for d in tokens}
    c = Counter(w for d, t in tokens.items() if not out[d] for w in t)
    n, v = sum(c.values()), len(c)
    base = lambda t: sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
    return {d: (out[d], len(t), sum(c[w] > 0 for w in t), n, base(t)) for d, t in tokens.items()}
