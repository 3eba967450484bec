import hashlib
import random
import types

import public_tokenizers
import sentencepiece

from millrace.llm import common, pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, " ", "  a  b ", "▁x ▁▁y", "a\nb\tc  ", "\x00 a", "日本語 😀 é é", "<s> </s> <unk> <0x41>", "​ x", "a" * 5000, "ﬁ ½ Ａ", "�", "a　b", "\u0085 q", "the The THE", "x" * 47 + "y", "😀" * 60]


def texts():
    rng = random.Random(1)
    alphabet = "aeinorst  .,é\n▁ñ"
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 120))) for _ in range(300)]


def test_digests_match_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = list(enumerate(texts()))
    got = {r.doc_id: r for r in pieces.digests(spark.createDataFrame(rows, "doc_id long, text string"), MODEL, ids=True).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        ids = library.encode(t or "")
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].n_differing == 0
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_both_agendas_agree():
    merger = pieces.encoder(MODEL).merger
    for t in filter(None, texts()):
        symbols = [pieces.MARK, *t.replace(" ", pieces.MARK)]
        assert merger._short(list(symbols)) == merger._long(list(symbols))


def test_memory_bound(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBER", 5)
    code = pieces.Encoder(MODEL)
    some = ["a b c d e f g h", "a b", "i j k l m n"]
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for _ in range(2):
        for t in some:
            (units,) = code.encode([t])
            assert [int(i) for u in units for i in code.coded[u].split(",")] == library.encode(t)


def test_encode_keeps_columns(spark):
    df = spark.createDataFrame([("q", 1, "a b"), ("r", 2, None)], "text2 string, doc_id long, text string")
    rows = pieces.encode(df, MODEL).orderBy("doc_id").collect()
    assert rows[0].text2 == "q" and rows[0].decoded == "a b" and rows[1].ids == []
    assert pieces.encode(df.limit(0), MODEL).count() == 0


def varint(raw, at):
    value = shift = 0
    while True:
        value |= (raw[at] & 127) << shift
        at += 1
        if raw[at - 1] < 128:
            return value, at
        shift += 7


def as_unigram(raw):
    """The model file with its kind (field 3 of the message in field 2) set to unigram."""
    raw, at = bytearray(raw), 0
    while at < len(raw):
        tag, at = varint(raw, at)
        size, at = varint(raw, at)
        if tag == 2 << 3 | 2:
            end = at + size
            while at < end:
                tag, at = varint(raw, at)
                if tag == 3 << 3:
                    raw[at] = 1
                    return bytes(raw)
                value, at = varint(raw, at)
                at += value if tag & 7 == 2 else 0
        at += size
    raise ValueError("no such field")


def test_counts_follow_the_library_with_the_same_pieces_as_unigrams(spark):
    library = sentencepiece.SentencePieceProcessor(model_proto=as_unigram(open(MODEL, "rb").read()))
    rows = [*enumerate([*texts(), "the The then of them " * 50, "theation the, thee"])]
    got = pieces.token_counts(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_chars string"), MODEL).collect()
    assert len(got) == len(rows)
    for r in got:
        t = rows[r.doc_id][1] or ""
        assert (r.n_chars, r.n_tokens) == (len(t), len(library.encode(t))), t
    assert pieces.token_counts(spark.createDataFrame([], "doc_id long, text string"), MODEL).count() == 0


def test_models_with_other_settings_match_the_library(spark, tmp_path):
    path = str(tmp_path / "other.model")
    with open(MODEL, "rb") as f:
        raw = f.read()
    with open(path, "wb") as f:
        f.write(raw + b"\x1a\x04\x18\x00\x20\x01")  # the normaliser puts no mark first and drops extra white space
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    assert not pieces.Vocabulary(path).plain and pieces.Vocabulary(MODEL).plain
    rows = list(enumerate(texts()[:60]))
    for r in pieces.digests(spark.createDataFrame(rows, "doc_id long, text string"), path, ids=True).collect():
        ids = library.encode(rows[r.doc_id][1] or "")
        assert r.ids == ids and r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_differences_take_the_librarys_ids(monkeypatch):
    code = pieces.Encoder(MODEL)
    monkeypatch.setattr(code.merger, "encode", lambda unit: [7])
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    (units,) = code.encode(["two words"])
    assert [int(i) for u in units for i in code.coded[u].split(",")] == library.encode("two words") and len(code.differing) == 2 and code.differ(units) == 2


def test_repeated_rows_long_texts_and_clashing_columns(spark):
    long = "words and " * 50_000
    df = spark.createDataFrame([(1, long, 1, "x"), (2, "a b", 2, "y"), (2, "a b", 3, "z")], "doc_id long, text string, ids int, decoded string")
    rows = pieces.encode(df, MODEL).orderBy("ids").collect()
    assert [len(r.ids_) for r in rows[1:]] == [2, 2] and rows[0].decoded_ == long and [r.decoded for r in rows] == ["x", "y", "z"]
    assert len(rows[0].ids_) == len(sentencepiece.SentencePieceProcessor(model_file=MODEL).encode(long))
    assert pieces.digests(df.limit(0), MODEL).count() == pieces.token_counts(df.limit(0), MODEL).count() == 0
    counts = pieces.token_counts(df, MODEL).orderBy("doc_id").collect()
    assert counts[1] == counts[2] and counts[0].n_chars == len(long)


def test_frequent_units_are_learned_once(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBER", 40)
    code = pieces.Encoder(MODEL)
    learned, encode = [], code.merger.encode
    monkeypatch.setattr(code.merger, "encode", lambda unit: learned.append(unit) or encode(unit))
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for k in range(60):
        t = "the of\nx and " + " ".join(f"w{k}q{j}" for j in range(8))
        (units,) = code.encode([t])
        assert ",".join(code.coded[u] for u in units) == ",".join(map(str, library.encode(t))) and code.text(units) == t
        assert len(code.coded) + len(code.earlier) <= 40 and len(code.odd) <= 40
    assert [learned.count(u) for u in ("the", "of\nx", "and")] == [1, 1, 1]


def test_units_are_remembered_until_another_stage_runs():
    code = pieces.encoder(MODEL)
    code.encode(["some units"])
    common.release(code)
    assert "units" in code.coded
    common.release()
    assert not code.coded and not code.earlier


def test_many_units_are_merged_together(monkeypatch):
    code = pieces.Encoder(MODEL)
    rng = random.Random(2)
    units = sorted({"".join(rng.choice("aeinorsth.,é\n▁ñ日😀") for _ in range(rng.randint(0, 60))).replace("▁", " ") for _ in range(3000)})
    apart, encode = [], code.merger.encode
    want = list(map(encode, units))
    monkeypatch.setattr(code.merger, "encode", lambda unit: apart.append(unit) or encode(unit))
    monkeypatch.setattr(code.merger, "MANY", 1, raising=False)
    monkeypatch.setattr(code.merger, "TOGETHER", 150, raising=False)
    code.learn(set(units))
    assert all(len(u) >= code.merger.LONG for u in apart) and not code.differing
    assert [code.coded[u] for u in units] == [",".join(map(str, ids)) for ids in want]
    library = code.merger.v.library
    assert [[int(i) for i in code.coded[u].split(",")] for u in units if u] == library.encode([u for u in units if u])
    assert all(code.odd.get(u, " " + u) == " " + library.decode([int(i) for i in code.coded[u].split(",")]) for u in units)


def test_equal_scores_and_characters_that_are_no_pieces():
    some = ["<unk>", "▁", "a", "b", "ab", "ba", "aba", "bc", "abc", "▁a", "▁ab", "cc", "bcc"]
    ids = {p: i for i, p in enumerate(some) if i}
    rng = random.Random(3)
    for raw in ({}, {b: 100 + b for b in range(256)}):
        for _ in range(20):
            scores = [float(-rng.randint(0, 4)) for _ in some]
            merger = pieces.Merger(types.SimpleNamespace(ids=ids, scores=scores, pieces=some, bytes=raw, unknown=0))
            units = ["".join(rng.choice("aabbc é") for _ in range(rng.randint(0, 14))) for _ in range(1000)]
            assert merger.encode_all(units) == list(map(merger.encode, units))
