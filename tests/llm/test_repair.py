import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from millrace.llm import repair

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", None, "a", "The the, THE. <|endoftext|> x", "### $$$", "don't we'll", "\x1c a\u0085b", "ΣΑΣ ß é é İ", "A<|endoftext|>B <|ENDOFTEXT|>", "the cat sat. " * 3000, "x" * 4000, "日本 2024"]


def ids_of(library, text):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, repair.END], "<u4")


@pytest.mark.parametrize("size", [repair.SHARD_IDS, 50])
def test_round_trip(spark, monkeypatch, size):
    library = Tokenizer.from_file(TOKENIZER)
    monkeypatch.setattr(repair, "SHARD_IDS", size)
    rows = [(i * 7 % 1009, TEXTS[i % len(TEXTS)], "x") for i in range(60)] + [(None, "null id", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string")
    got = {r.doc_id: r for r in repair.round_trip(df, TOKENIZER).collect()}
    assert len(got) == len(rows)
    start = 0
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = ids_of(library, t)
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes())), t
        start += len(ids)


def test_repeated_ids_are_kept(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b b")], "doc_id long, text string")
    rows = sorted((r.start, r.n_tokens) for r in repair.round_trip(df, TOKENIZER).collect())
    assert len(rows) == 3 and all(a[0] + a[1] == b[0] for a, b in zip(rows, rows[1:]))


def test_grammar_expands_and_documents_are_found_alone():
    rng = np.random.default_rng(0)
    lengths = np.array([1, 500, 1, 4000, 3, 20000])
    ids = [np.where(rng.random(n) < 0.7, 7, rng.integers(0, 40, n)).astype("<u4") for n in lengths]
    raw = repair.pack([3, None, 5, 6, 7, 8], np.concatenate(ids), np.array([len(x) for x in ids]), 4, 9)
    shard = repair.Shard(raw)
    assert (shard.task, shard.shard, shard.ids) == (4, 9, lengths.sum()) and len(shard.rules) > 10
    assert len(raw) < 4 * lengths.sum() * 0.6
    assert shard.doc_ids == [3, None, 5, 6, 7, 8]
    for i in (5, 0, 3, 1):
        assert (shard.document(i) == ids[i]).all()
    assert all((a == b).all() for (_, a), b in zip(shard.documents(), ids))


def test_runs_of_one_id():
    ids = np.full(1001, 9, "<u4")
    shard = repair.Shard(repair.pack([1], ids, np.array([len(ids)]), 0, 0))
    assert (shard.document(0) == ids).all() and len(shard.symbols) < 600


def test_units_match_whole_texts(spark):
    """Units between white space, words with their marks, and odd letters give what the library gives for the whole text."""
    rng = np.random.default_rng(3)
    signs = [*"abcİßéΣς.,'!?-0123é日本ﬁǅªº ½\u0301\u200b\x01\x1c"]
    texts = ["".join(rng.choice(signs, rng.integers(0, 40), p=None)) for _ in range(400)]
    texts = [t.replace("½", " \n") for t in texts] + ["word, word. İ. İ, ǅ. é, don't, 'll, It's. " * 5, "<|startoftext|>, a", "A" * 30_000]
    library = Tokenizer.from_file(TOKENIZER)
    code = repair.Encoder(TOKENIZER)
    for _ in range(2):  # once to learn, once from memory
        ids, n = code.encode(pa.array(texts))
        ends = np.cumsum(n)
        for t, a, b in zip(texts, ends - n, ends):
            assert ids[a:b].tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_other_tokenizers_get_whole_texts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    assert not repair.Encoder(path).splits
    for r in repair.round_trip(df, path).collect():
        assert r.ids_crc32 == zlib.crc32(ids_of(library, TEXTS[r.doc_id]).tobytes())


def test_no_pair_stays_frequent():
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 300, 200)
    ids = rng.zipf(1.4, lengths.sum()).clip(max=500).astype(np.uint32)
    symbols, per, rules, first = repair.compress(ids, lengths)
    last = np.zeros(len(symbols), bool)
    last[np.cumsum(per) - 1] = True
    left, right = symbols[:-1][~last[:-1]], symbols[1:][~last[:-1]]
    pairs, counts = np.unique(left << 24 | right, return_counts=True)
    assert counts.max() < repair.LEAST_COUNT and len({tuple(r) for r in rules.tolist()}) == len(rules) > 20


def test_repeated_rows_and_very_long_texts(spark, monkeypatch):
    monkeypatch.setattr(repair, "SLICE", 1 << 12)
    monkeypatch.setattr(repair, "REMEMBER", 50)
    library = Tokenizer.from_file(TOKENIZER)
    long = " ".join(f"w{i % 977}x{i % 13}." for i in range(60_000))
    df = spark.createDataFrame([(2, "same words here"), (2, "same words here"), (1, long), (3, None)], "doc_id long, text string")
    rows = sorted(repair.round_trip(df, TOKENIZER).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [1, 2, 2, 3]
    assert [r.n_tokens for r in rows] == [len(ids_of(library, t)) for t in (long, "same words here", "same words here", None)]
    assert rows[0].ids_crc32 == zlib.crc32(ids_of(library, long).tobytes())


def test_empty_table(spark):
    assert repair.round_trip(spark.createDataFrame([], "doc_id long, text string"), TOKENIZER).count() == 0
