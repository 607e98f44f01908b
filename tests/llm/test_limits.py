"""What keeps the operators within memory, disk and time: of each, what has to be there for it."""

import random

import numpy as np
import pytest

import corpus_pipeline
from barlab.llm import common, gif, suffix_tree, token_files
from barlab.operators.staging import staged_path


def test_stages_begin_with_a_collected_heap(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    count = lambda: sum(b.getCollectionCount() for b in beans if "Young" not in b.getName())
    before, rows = count(), spark.conf.get(common.BATCH)
    try:
        corpus_pipeline.text_batches(spark)
        assert count() > before and spark.conf.get(common.BATCH) == "2000"
    finally:
        spark.conf.set(common.BATCH, rows)


def plain_codes(codes, clear):
    entries, out, previous = [bytes([i]) for i in range(clear)] + [b"", b""], [], b""
    for code in codes:
        e = entries[code] if code < len(entries) else previous + previous[:1]
        out.append(e)
        if previous and len(entries) < 4096:
            entries.append(previous + e[:1])
        previous = e
    return b"".join(out)


def test_codes_are_expanded_together(monkeypatch):
    monkeypatch.setattr(gif, "SLICE_BYTES", 500)  # so that stretches reach back beyond a part
    rnd = random.Random(3)
    for n in (1, 2, 9, 700, 6000):
        codes = np.array([rnd.randrange(256), *(rnd.choice([rnd.randrange(256), 258 + max(i - rnd.randrange(1, 9), 0), 258 + rnd.randrange(i)]) for i in range(1, n))]).clip(0, 4095)
        codes[(codes == 256) | (codes == 257)] = 7
        assert gif._expanded(codes, 256, 1 << 40) == plain_codes(codes.tolist(), 256)
    with pytest.raises(ValueError, match="beyond its table"):
        gif._expanded(np.array([258, 1]), 256, 9)


def test_covering_frames_are_counted_as_they_are_drawn():
    rnd = np.random.default_rng(2)
    frames = [gif.Frame(0, 0, 8, 4, rnd.integers(0, 6, (4, 8)).astype(np.uint8), rnd.integers(0, 256, (6, 3)).astype(np.uint8), 4, d) for d in (0, 2, 3)]
    drawn = [(int((c[..., 3] == 0).sum()), gif.histogram(c).tolist()) for _, c in gif.composed((8, 4), frames)]
    assert [(n, h.tolist()) for _, n, h in gif.shown((8, 4), frames)] == drawn
    frames[1].pixels = np.full((4, 8), 9, np.uint8)
    with pytest.raises(IndexError):
        list(gif.shown((8, 4), frames))


def test_pieces_are_learned_once():
    encoder, letters = token_files.encoder_of(token_files.default_tokenizer()), "abcdefghijklmnopqrstuvwxyz"
    text = "a " + " ".join(letters[i % 26] + letters[i // 26 % 26] + letters[i // 676 % 26] + letters[i // 17576] for i in range(200_000))
    first, _ = encoder.encoded([text])

    def learn(pieces):
        raise AssertionError(f"{len(pieces)} pieces were forgotten")

    encoder._learn = learn
    assert np.array_equal(encoder.encoded([text])[0], first)


def test_marked_words_are_the_librarys():
    from tokenizers import Tokenizer

    path = token_files.default_tokenizer()
    texts = ["a. word, word. éß; x1. 日本。 ...", " lead! ʰa. aʰ, á. 4. ab.c. <|endoftext|>, end?", "", "<|endoftext|>. plain, words:"]
    encoder, plain = token_files.encoder_of(path), Tokenizer.from_file(path)
    for group in (texts, texts[:1], texts[1:]):
        assert [np.frombuffer(x, encoder.kind).tolist() for x in encoder(group)] == [[*plain.encode(t, add_special_tokens=False).ids, 0] for t in group]


def test_words_at_a_line_feed_are_learned_apart(monkeypatch):
    from tokenizers import Tokenizer

    encoder, plain = token_files.encoder_of(token_files.default_tokenizer()), Tokenizer.from_file(token_files.default_tokenizer())
    single, learn = [], encoder._learn_texts
    monkeypatch.setattr(encoder, "_learn_texts", lambda texts: (single.extend(texts), learn(texts)))
    words = [a + b for a in "bdfgkl" for b in ("a", "é", "ou", "日", "ж", "in")]
    texts = [f"x {a}.\n{b.capitalize()} {a}\n{b}***" for a in words for b in words]
    assert [np.frombuffer(x, encoder.kind).tolist() for x in encoder(texts)] == [[*plain.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    assert len(encoder.keys) < 10 * len(words) and not any(t.isalpha() for t in single)  # not a piece for each pair of words


@pytest.mark.parametrize("kind", ["usual", "other cut"])
def test_any_text_and_cut_has_the_librarys_ids(tmp_path, kind):
    from tokenizers import Regex, Tokenizer, pre_tokenizers

    library = Tokenizer.from_file(token_files.default_tokenizer())
    if kind == "other cut":
        split = pre_tokenizers.Split(Regex(r" ?[A-Z]?[^\sA-Z\p{P}]*|[\p{P}]+[\r\n]*|\s+(?!\S)|\s+"), "isolated")
        library.pre_tokenizer = pre_tokenizers.Sequence([split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    library.save(path := str(tmp_path / "tokenizer.json"))
    marks, dice = ["a", "Bc", "é", "\n", "\n", " ", " ", " ", ".", ",", "'s", "'", "12", "日本", "ʰ", "\t", "\r", "\u3000", "\xa0", "\x85", "\x1c", "\u0120", "\u010a", "<|endoftext|>", "***", "한", "ж", "😀", "ª", "\u0301", "\0"], random.Random(kind)
    encoder = token_files.encoder_of(path)
    for n in (1, 3000, 3000):
        texts = [None, "", "\n", "\n\n", "a\n", "\na", " a", "a ", "a\n\nb", *("".join(dice.choices(marks, k=dice.randrange(12))) for _ in range(n))]
        assert [np.frombuffer(x, encoder.kind).tolist() for x in encoder(texts)] == [[*library.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]


def test_token_files_put_the_batch_size_back(spark):
    docs, rows = spark.createDataFrame([(i, f"text {i}") for i in range(9)], "doc_id bigint, text string"), spark.conf.get(common.BATCH)
    assert token_files.read_token_files(token_files.write_token_files(docs, token_files.default_tokenizer())).count() == 9
    assert spark.conf.get(common.BATCH) == rows


def test_tree_and_words_go_before_the_scores_are_joined(spark):
    documents = [(i, " ".join(["zz"] * (i % 4) + [f"w{i % 7}", "the"])) for i in range(60)]
    folder = spark._jvm.org.apache.hadoop.fs.Path(staged_path(spark, "x")).getParent()
    left = lambda: {str(f.getPath().getName()) for f in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)}
    staged_path(spark, "x")
    common.staged(spark.range(1), "x")
    before = left()
    out = suffix_tree.score_texts(spark.createDataFrame(documents, "doc_id bigint, text string"), head=0, head_entries=0, divergence=1.0)
    assert {n.split("-")[0] for n in left() - before} <= {"scored", "far", "tail"}
    found, plain = {r.doc_id: r for r in out.collect()}, suffix_tree.brute_force(documents)
    assert {d: (r.held_out, r.n_tokens, r.n_known, r.train_tokens) for d, r in found.items()} == {d: p[:4] for d, p in plain.items()}
    assert all(abs(found[d].base_score - p[4]) < 1e-9 for d, p in plain.items())
