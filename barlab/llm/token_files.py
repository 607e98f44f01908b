"""Token-id files: ids ranked by frequency in byte-aligned variable-length coding.

A file holds consecutive documents in ascending doc_id order:

    "BLV1" | n_docs, n_ids, n_ranks: 3 x uint32
    ids by falling frequency in this file (ties: smaller id first): n_ranks x uint32
    doc ids: n_docs x int64 | 1 for each null doc id: n_docs x uint8 | lengths: n_docs x uint32
    control bytes: two bits for each id, its count of data bytes less 1, four ids a byte
    data bytes: the ranks, little-endian, without leading zero bytes

Control and data bytes lie apart, so that numpy reads a whole file by table lookup: each
control byte gives four lengths, their running sum the offsets, and ranks map to ids.
Documents are range-partitioned by doc_id, and a task streams its range into files of a
bounded number of ids; a file is a row of a table in the shared folder.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.llm.common import lean, running_total, slices, staged, table, text_batches

MAGIC, SLICE_BYTES, FILE_IDS = b"BLV1", 8 << 20, 1 << 21
LENGTHS = np.array([[(b >> 2 * k & 3) + 1 for k in range(4)] for b in range(256)], np.uint8)
PIECES, RUN = 600_000, 20_000  # that a task remembers, at about 40 bytes each
INNER_SPACE = re.compile(r"(?<=\S) (?=\S)")
NOT_PLAIN = r"  | \n|\n[ \n]|[\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"  # for Arrow
LETTER = r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}\x{391}-\x{3a1}\x{3a3}-\x{3c9}\x{400}-\x{481}\x{3041}-\x{3096}\x{30a1}-\x{30fa}\x{4e00}-\x{9fa5}\x{ac00}-\x{d7a3}]"  # one to every version of Unicode
WORD, BARE, MARKED = rf"^ {LETTER}+$", rf"^{LETTER}+$", rf"^(?P<stem> ?{LETTER}+)(?P<mark>[!-&(-@\[-`{{-~]+)$"
PART = re.compile(r" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+| ?[!-&(-@\[-`{-~]+\n?|\n")  # no apostrophe
ENDS = frozenset(".,;:!?")
SPACE, NEWLINE = "\u0120", "\u010a"  # how a byte-level vocabulary writes them


def pack(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """One file of the documents' ids."""
    counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    by_rank = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)].astype("<u4")
    rank = np.zeros(len(counts), "<u4")
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    ranks = rank[ids]
    width = max(1, -(-max(len(by_rank) - 1, 0).bit_length() // 8))  # bytes of the largest rank
    written = np.ones((len(ids), width), bool)
    control = np.zeros(-(-len(ids) // 4) * 4, np.uint8)
    for k in range(1, width):
        np.greater(ranks, (1 << 8 * k) - 1, out=written[:, k])
        control[: len(ids)] += written[:, k]
    data = ranks.view(np.uint8).reshape(-1, 4)[:, :width].reshape(-1)[written.reshape(-1)]
    control = control[::4] | control[1::4] << np.uint8(2) | control[2::4] << np.uint8(4) | control[3::4] << np.uint8(6)
    null = np.array([d is None for d in doc_ids], np.uint8)
    numbers = np.array([d or 0 for d in doc_ids], "<i8")
    head = np.array([len(doc_ids), len(ids), len(by_rank)], "<u4")
    return b"".join([MAGIC, *(x.tobytes() for x in (head, by_rank, numbers, null, np.array(lengths, "<u4"), control, data))])


def unpack(file: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc ids, lengths and all ids of a file."""
    if file[:4] != MAGIC:
        raise ValueError("not a token-id file")
    n_docs, n_ids, n_ranks = np.frombuffer(file, "<u4", 3, 4).tolist()
    at = 16

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(file, kind, n, at)
        at += out.nbytes
        return out

    by_rank, numbers, null, lengths = take("<u4", n_ranks), take("<i8", n_docs), take("u1", n_docs), take("<u4", n_docs)
    size = LENGTHS[take("u1", -(-n_ids // 4))].reshape(-1)[:n_ids]
    data = take("u1", len(file) - at)
    start = np.cumsum(size, dtype=np.int64) - size
    ranks = data[start].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        ranks[more] |= data[start[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return [None if z else d for d, z in zip(numbers.tolist(), null.tolist(), strict=True)], lengths, by_rank[ranks]


def joined(texts: pa.Array, between: str) -> str:
    """The texts of a slice in a row, as str.join would have them, without a Python string for each."""
    return pa.compute.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts.cast(pa.string())), between)[0].as_py()


class Encoder:
    """Ids of whole texts, as bytes. A space between two other characters always begins a
    pre-token of byte-level BPE, and a line feed between two is one by its usual cuts, so
    texts are cut there; other white space stays inside its piece. The distinct pieces of a
    slice are found by Arrow's dictionary encoding, and the slice's ids are gathered from
    theirs by numpy. A new piece of letters, ASCII marks and digits is cut again where those
    meet, which ends pre-tokens, too, and the library encodes each part once: letters in
    long runs, others by themselves. Pieces that were seen are found again by Arrow; those
    that were not used for longest are forgotten beyond a number. Ids do not depend on what
    is kept."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.kind = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        own = set(range(0x21, 0x7F)) | set(range(0xA1, 0xAD)) | set(range(0xAE, 0x100))  # bytes that stand for themselves
        others = iter(range(0x100, 0x200))
        self.written = np.array([b if b in own else next(others) for b in range(256)], "<u2")
        self.whole_cut, self.newline = (cut := self.tokenizer.pre_tokenizer), vocabulary.get(NEWLINE, -1)
        self.usual = isinstance(cut, pre_tokenizers.ByteLevel) and cut.use_regex and not cut.add_prefix_space and self.tokenizer.normalizer is None
        self.word_cut, self.bare_cut = pre_tokenizers.Split(SPACE, "merged_with_next"), pre_tokenizers.Split(NEWLINE, "isolated")
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for t, i in vocabulary.items() if t.startswith(SPACE)]] = True
        self.added = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"\Z\A.")
        self.keys, self.calls = pa.array([], pa.large_string()), 0  # the pieces that are kept, with
        self.size, self.used, self.ids = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, self.kind)

    def _words(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All texts' words (what stands between cuts) in a row, and how many each has."""
        c = pa.compute
        odd = c.match_substring_regex(texts, NOT_PLAIN if self.usual else NOT_PLAIN + r"|\n")
        plain = c.split_pattern(c.replace_substring(texts.filter(c.invert(odd)), "\n", " \n "), " ")
        cut = pa.array([INNER_SPACE.split(t) for t in texts.filter(odd).to_pylist()], plain.type)
        lists = pa.concat_arrays([plain, cut]).take(pa.array(np.argsort(np.argsort(odd.to_numpy(zero_copy_only=False), kind="stable")))) if len(cut) else plain
        return lists.flatten(), c.list_value_length(lists).to_numpy()

    def _parts(self, piece: str) -> list[str]:
        if piece[1:].isalpha():
            return [piece]
        if piece[-1:] in ENDS and piece[1:-1].isalpha():
            return [piece[:-1], piece[-1]]
        parts = PART.findall(piece)
        return [piece] if len(parts) < 2 or "\n\n" in piece or sum(map(len, parts)) < len(piece) else parts

    def _find(self, pieces: pa.Array, since: int = 0) -> np.ndarray:
        """The place of each piece among those that are kept, or -1 (for a repeated piece
        after its first time, too); found ones count as used."""
        found = pa.compute.index_in(self.keys[since:], value_set=pieces)
        kept = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False)) + since
        self.used[kept] = self.calls
        at = np.full(len(pieces), -1, np.int64)
        at[found.drop_null().to_numpy()] = kept
        return at

    def _keep(self, pieces: pa.Array, size: np.ndarray, ids: np.ndarray) -> None:
        self.keys = pa.concat_arrays([self.keys, pieces])
        self.size, self.used = np.append(self.size, size.astype(np.int32)), np.append(self.used, np.full(len(size), self.calls, np.int32))
        self.ids = np.append(self.ids, ids)

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of kept pieces in a row, and how many each has."""
        size = self.size[at]
        stop = np.cumsum(size)
        kind = np.int32 if max(len(self.ids), stop[-1]) < 1 << 30 else np.int64
        shift = (np.cumsum(self.size) - self.size).astype(kind)[at] - (stop - size).astype(kind)
        where = np.repeat(shift, size)
        where += np.arange(len(where), dtype=kind)
        return self.ids[where], size

    def _run_ids(self, run: pa.Array, between: str, cut) -> np.ndarray | None:
        """The ids of a run of pieces in a row, None where it has added tokens. With the usual
        cuts of byte-level BPE it is written as the vocabulary writes its bytes, and the library
        has to find the ends of pieces alone."""
        plain = joined(run, between)
        if not self.usual:
            return None if self.added.search(plain) else np.array(self.tokenizer.encode_batch_fast([plain], add_special_tokens=False)[0].ids, self.kind)
        text = self.written[np.frombuffer(plain.encode(), np.uint8)].tobytes().decode("utf-16-le")
        if self.added.search(plain) or self.added.search(text):
            return None
        self.tokenizer.pre_tokenizer = cut
        try:
            return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
        finally:
            self.tokenizer.pre_tokenizer = self.whole_cut

    def _learn_words(self, words: pa.Array) -> list[str]:
        """Keep pieces of a space and letters: a run of them is encoded as one text, whose
        words begin where an id has a space. Those for which that is not so are returned."""
        left: list[str] = []
        for a in range(0, len(words), RUN):
            run = words[a : a + RUN]
            ids = self._run_ids(run, "", self.word_cut)
            at = np.zeros(0, np.int64) if ids is None else np.flatnonzero(self.begins[ids])
            if len(at) == len(run):
                self._keep(run, np.diff(np.append(at, len(ids))), ids)
            else:
                left += run.to_pylist()
        return left

    def _learn_bare(self, words: pa.Array) -> list[str]:
        """The same for pieces of letters alone, which line feeds keep apart."""
        if not self.usual:
            return words.to_pylist()
        left: list[str] = []
        for a in range(0, len(words), RUN):
            run = words[a : a + RUN]
            ids = self._run_ids(run, "\n", self.bare_cut)
            at = np.zeros(0, np.int64) if ids is None else np.flatnonzero(ids == self.newline)
            if len(at) == len(run) - 1 and ids is not None:
                self._keep(run, np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1, np.delete(ids, at))
            else:
                left += run.to_pylist()
        return left

    def _learn_texts(self, texts: list[str]) -> None:
        """Keep pieces as the library encodes them, each by itself."""
        for a in range(0, len(texts), RUN):
            part = texts[a : a + RUN]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            self._keep(pa.array(part, pa.large_string()), np.array([len(x) for x in found], np.int64), np.array([i for x in found for i in x], self.kind))

    def _learn_letters(self, pieces: pa.Array) -> tuple[pa.Array, list[str]]:
        """Keep pieces that are letters, with a space before them or not: the others, and
        those that must be encoded by themselves."""
        whole: list[str] = []
        for pattern, learn in ((WORD, self._learn_words), (BARE, self._learn_bare)):
            fit = pa.compute.match_substring_regex(pieces, pattern)
            whole += learn(pieces.filter(fit))
            pieces = pieces.filter(pa.compute.invert(fit))
        return pieces, whole

    def _learn(self, pieces: pa.Array) -> None:
        """Keep distinct pieces that are not kept yet, and the parts of those that are cut."""
        pieces, whole = self._learn_letters(pieces)
        added = self.added.search(joined(pieces, "\n")) is not None  # then each piece is looked at
        rest, marked = pieces.to_pylist() if added else [], pieces.slice(0, 0)
        stems = marks = marked
        if not added:  # letters and marks, which _parts would cut in two
            both = pa.compute.extract_regex(pieces, MARKED)
            ends = both.is_valid()
            marked, rest = pieces.filter(ends), pieces.filter(pa.compute.invert(ends)).to_pylist()
            stems, marks = (both.field(k).filter(ends) for k in (0, 1))
        cut = []
        for p in rest:
            parts = [p] if added and self.added.search(p) else self._parts(p)
            if len(parts) > 1:
                cut.append((p, parts))
            else:
                whole.append(p)
        self._learn_texts(whole)
        if cut or len(marked):
            pairs = pa.concat_arrays([stems, marks]).take(pa.array(np.arange(2 * len(marked)).reshape(2, -1).T.reshape(-1)))
            flat = pa.concat_arrays([pairs, pa.array([x for _, parts in cut for x in parts], pa.large_string())]).dictionary_encode()
            at = self._find(flat.dictionary)
            since, new = len(self.keys), np.flatnonzero(at < 0)
            if len(new):
                unknown = flat.dictionary.take(pa.array(new))
                others, whole = self._learn_letters(unknown)
                self._learn_texts(whole + others.to_pylist())
                at[new] = self._find(unknown, since)
            ids, size = self._gather(at[flat.indices.to_numpy()])
            n_parts = np.array([2] * len(marked) + [len(parts) for _, parts in cut])
            self._keep(pa.concat_arrays([marked, pa.array([p for p, _ in cut], pa.large_string())]), np.add.reduceat(size, np.cumsum(n_parts) - n_parts), ids)

    def _forget(self) -> None:
        if len(self.keys) > PIECES:
            keep = np.sort(np.argpartition(-self.used, 2 * PIECES // 3)[: 2 * PIECES // 3])
            self.ids = self.ids[np.repeat(np.isin(np.arange(len(self.size)), keep, assume_unique=True), self.size)]
            self.keys, self.size, self.used = self.keys.take(pa.array(keep)), self.size[keep], self.used[keep]

    def encoded(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each text's followed by the end id, and where each
        text's ids end."""
        if not len(texts):
            return np.zeros(0, self.kind), np.zeros(0, np.int64)
        self.calls += 1
        self._forget()
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.large_string()).fill_null("")
        words, n_words = self._words(texts)
        first = np.cumsum(n_words) - n_words
        coded = words.dictionary_encode()
        which = coded.indices.to_numpy().astype(np.int64)
        feed = np.flatnonzero(which == coded.dictionary.index("\n").as_py())
        bare = np.unique(np.concatenate([first, feed, feed + 1]))  # words with no space before them: a text's first, line feeds and what follows
        bare = bare[: np.searchsorted(bare, len(which))]
        heads = words.take(pa.array(bare)).dictionary_encode()
        pieces = pa.concat_arrays([pa.compute.binary_join_element_wise(pa.scalar(" ", pa.large_string()), coded.dictionary, pa.scalar("", pa.large_string())), heads.dictionary])
        which[bare] = heads.indices.to_numpy() + len(coded.dictionary)
        at, known = self._find(pieces), len(self.keys)
        new = np.flatnonzero(at < 0)
        if len(new):
            unknown = pieces.take(pa.array(new)).dictionary_encode()
            self._learn(unknown.dictionary)
            at[new] = self._find(unknown.dictionary, known)[unknown.indices.to_numpy()]
        end = len(self.keys)
        self._keep(pa.array(["\0end"], pa.large_string()), np.ones(1, np.int64), np.zeros(1, self.kind))  # for this call
        ids, n = self._gather(np.append(at, end)[np.insert(which, np.cumsum(n_words), len(at))])
        self.keys, self.size, self.used, self.ids = self.keys[:end], self.size[:-1], self.used[:-1], self.ids[:-1]
        return ids, np.cumsum(np.add.reduceat(n, first + np.arange(len(texts))))

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        ids, stop = self.encoded(texts)
        return [ids[i:j].tobytes() for i, j in zip([0, *stop[:-1].tolist()], stop.tolist(), strict=True)]


def encoder_of(path: str) -> Encoder:
    """A new encoder. It lives as long as its task: a worker process serves other operators
    after it, which would have to do with the memory that is left."""
    return Encoder(path)


def _encode(path: str):
    def run(batches):
        encoder, part, seq = encoder_of(path), TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        docs: list[int | None] = []
        total = 0

        def file() -> pa.RecordBatch:
            body = pack(docs, [len(x) for x in held], np.concatenate(held))
            return pa.RecordBatch.from_arrays([pa.array([part << 24 | seq]), pa.array([len(docs)]), pa.array([total]), pa.array([body], pa.binary())], names=["file", "n_docs", "n_ids", "body"])

        for batch in batches:
            sizes = pa.compute.binary_length(batch.column(1)).fill_null(0).to_pylist()
            for a, b in slices(sizes, SLICE_BYTES):
                ids, stop = encoder.encoded(batch.column(1)[a:b])
                for doc, x in zip(batch.column(0)[a:b].to_pylist(), np.split(ids, stop[:-1]), strict=True):
                    held.append(x)
                    docs.append(doc)
                    total += len(x)
                    if total >= FILE_IDS:
                        yield file()
                        held, docs, total, seq = [], [], 0, seq + 1
        if docs:
            yield file()

    return run


def write_token_files(documents: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = 32 << 20) -> DataFrame:
    """The files of all documents, as a staged table (file, n_docs, n_ids, body), ``file``
    rising in doc_id order. Ids are integers; null ids come first, rows that repeat an id
    follow each other in order of their texts. A null or empty text is just the end id."""
    docs = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = docs.repartitionByRange(max(1, -(-size // range_bytes)), "doc_id").sortWithinPartitions("doc_id", "text")
    with text_batches(documents.sparkSession):
        return staged(ranges.mapInArrow(lean(_encode(tokenizer_path)), "file bigint, n_docs bigint, n_ids bigint, body binary"), "token-files")[0]


def _decode(batches):
    for batch in batches:
        for name, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            docs, lengths, ids = unpack(body.as_py())
            stop = np.cumsum(lengths, dtype=np.int64)
            crc = [zlib.crc32(memoryview(ids[e - n : e]).cast("B")) for e, n in zip(stop.tolist(), lengths.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(docs), pa.int64()), pa.array(docs, pa.int64()), pa.array(stop - lengths), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], names=["file", "doc_id", "inner", "n_tokens", "ids_crc32"])


def read_token_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files."""
    docs = files.select("file", "body").mapInArrow(lean(_decode), "file bigint, doc_id bigint, inner bigint, n_tokens bigint, ids_crc32 bigint")
    starts = running_total(files.select("file", "n_ids"), "file", "n_ids", "before", 1 << 32).select("file", "before")
    return docs.join(starts, "file").select("doc_id", (F.col("before") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(files: DataFrame) -> DataFrame:
    """(doc_id, ids array<int>) of every document in the files."""

    def run(batches):
        for batch in batches:
            for body in batch.column(0):
                docs, lengths, ids = unpack(body.as_py())
                at = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])

    return files.select("body").mapInArrow(lean(run), "doc_id bigint, ids array<int>")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_token_files(spark, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files read back."""
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), default_tokenizer()))
