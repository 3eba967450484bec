import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from millrace.llm import lm
from millrace.llm.common import LOWER

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def language(seed=1, size=60):
    rng = np.random.default_rng(seed)
    all_ = rng.integers(1, 50, size)
    first = rng.integers(0, 100, size) * (rng.random(size) < 0.6)
    first[lm._END] = 9
    return lm.Language(first.astype(float), rng.integers(0, 9, size).astype(float), np.minimum(all_, rng.integers(0, 9, size)).astype(float), all_.astype(float))


def parameters(language, seed=3):
    rng = np.random.default_rng(seed)
    return {n: x + rng.standard_normal(x.shape).astype(np.float32) * 0.3 for n, x in lm.initial(language).items()}


def documents(seed=2, lengths=(0, 1, 5, lm.QUERIES - 1, lm.QUERIES, 130, 3)):
    rng = np.random.default_rng(seed)
    per = rng.integers(1, 6, 40)
    per[7] = lm.KEYS + 9  # a word that fills a window's ids
    ids = rng.integers(3, 60, per.sum())
    return lm.Words(ids, per), rng.integers(0, 40, sum(lengths)), np.array(lengths)


def test_tree_paths_are_a_probability():
    counts = np.random.default_rng(0).integers(1, 1000, 37) + 0.5
    tree = lm.Tree(counts)
    m = {"u": np.zeros((36, lm.WIDTH), np.float32)}
    got = lm.log_leaf(m, tree, np.zeros((37, lm.WIDTH), np.float32), np.arange(37))
    assert np.allclose(np.exp(got), counts / counts.sum(), rtol=1e-4)  # without a state the tree gives the counts' shares
    m["u"] = np.random.default_rng(1).standard_normal((36, lm.WIDTH)).astype(np.float32)
    got = lm.log_leaf(m, tree, np.ones((37, lm.WIDTH), np.float32), np.arange(37))
    assert math.isclose(np.exp(got).sum(), 1, rel_tol=1e-4)


def test_gradients_match_differences():
    own = language()
    m = {n: x.astype(np.float64) for n, x in parameters(own).items()}
    own.tree.bias = own.tree.bias.astype(np.float64)
    words, flat, sizes = documents()
    windows = lm.Windows(words, words.tokens(flat, sizes), sizes)
    query, counts, keys, last, mask = windows[np.arange(len(windows))]
    rest = own.row[keys], own.row[last], mask, counts, own.leaf[windows.target[query]]

    def loss(m):
        states = lm.attend(m, *rest[:3])[0][counts.ravel()]
        return -brute_leaf(m, own.tree, states, rest[4][counts]).mean()

    _, g = lm.gradients(m, own.tree, *rest)
    rng = np.random.default_rng(5)
    for n in m:
        full = g[n]
        if n in ("e", "u"):
            full = np.zeros_like(m[n])
            full[g[n][0]] = g[n][1]
        for _ in range(4):
            i = tuple(rng.integers(0, s) for s in m[n].shape)
            at = m[n][i]
            m[n][i] = at + 1e-5
            up = loss(m)
            m[n][i] = at - 1e-5
            down = loss(m)
            m[n][i] = at
            assert math.isclose((up - down) / 2e-5, full[i], rel_tol=2e-3, abs_tol=1e-5)


def brute_leaf(m, tree, states, leaf):
    out = np.zeros(len(leaf))
    for k, (state, at) in enumerate(zip(states, leaf)):
        for step in range(tree.starts[at], tree.starts[at] + tree.lengths[at]):
            z = tree.signs[step] * (m["u"][tree.nodes[step]] @ state + tree.bias[tree.nodes[step]])
            out[k] -= np.log1p(np.exp(-z))
    return out


def brute_tokens(m, own, words, flat, sizes):
    """Log probability of the first id of each token, one by one: attention over the window's ids up to the token."""
    out, at = [], 0
    for n in sizes:
        numbers = [words.begin, *flat[at : at + n].tolist()]
        targets = [*(words.first[w] for w in flat[at : at + n]), lm._END]
        at += n
        ids = [words.ids[words.offset[w] : words.offset[w] + words.per[w]] for w in numbers]
        ends = np.cumsum([len(i) for i in ids])
        seq = np.concatenate(ids)
        for j, target in enumerate(targets):
            stop = ends[min(len(targets), j - j % lm.QUERIES + lm.QUERIES) - 1]  # where the token's window ends
            x = m["e"][own.row[seq[max(0, stop - lm.KEYS) : ends[j]]]].astype(np.float64)
            last = m["e"][own.row[seq[ends[j] - 1]]].astype(np.float64)
            a = np.exp(x @ (last @ m["q"]))
            pooled = a @ x / (1 + a.sum()) if len(x) else np.zeros(lm.WIDTH)
            out.append(brute_leaf(m, own.tree, [last @ m["x"] + pooled @ m["c"]], [own.leaf[target]])[0])
    return np.array(out)


def test_every_token_is_scored_once_as_one_by_one():
    own = language()
    m = parameters(own)
    words, flat, sizes = documents()
    windows = lm.Windows(words, words.tokens(flat, sizes), sizes)
    assert np.array_equal(np.sort(np.concatenate([q[c] for q, c in [windows[np.arange(len(windows))][:2]]])), np.arange(len(flat) + len(sizes)))
    assert np.allclose(lm.Scorer(m, own).score(windows), brute_tokens(m, own, words, flat, sizes), rtol=1e-3, atol=1e-3)


def test_rest_of_words_sums_to_at_most_one():
    own = language()
    first = int(np.flatnonzero(own.first)[3])
    words = [[first], *([first, i] for i in range(60)), *([first, i, j] for i in range(60) for j in range(60))]
    ids, per = np.array([i for w in words for i in w]), np.array([len(w) for w in words])
    counts = np.zeros(len(words), np.int64)
    counts[1] = own.first[first]
    assert np.exp(own.rest(ids, per, counts)).sum() <= 1 + 1e-9


def texts():
    rng = np.random.default_rng(5)
    words = [f"wo{i % 7}rd{i}" for i in range(80)]
    out = [(i, " ".join(rng.choice(words, rng.integers(1, 60)))) for i in range(60)]
    return out + [(60, ""), (61, None), (62, "The END the"), (63, "lone "), (64, "x" * 3000), (65, "a▁b ▁"), (66, "​   x"), (67, "long " * 40_000)]


@pytest.mark.parametrize("chunk", [1 << 20, 500])
def test_base_matches_brute_force(spark, chunk):
    rows = texts()
    got = {r.doc_id: r for r in lm.scores(spark.createDataFrame(rows, "doc_id long, text string"), MODEL, chunk=chunk).collect()}
    tokens = {i: (t or "").encode().translate(LOWER).split() + [None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    counts = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(rows)
    for i, ws in tokens.items():
        r = got[i]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isfinite(r.score) and r.score < 0


def test_score_matches_brute_force(spark, monkeypatch):
    """The whole score of every text, from the fitted parameters, token by token."""
    rows = texts()[:-1]
    seen = {}
    fit = lm.fit

    def keep(packed, own, kind):
        seen["m"], seen["own"] = fit(packed, own, kind), own
        return seen["m"]

    monkeypatch.setattr(lm, "fit", keep)
    got = {r.doc_id: r.score for r in lm.scores(spark.createDataFrame(rows, "doc_id long, text string"), MODEL, chunk=4000).collect()}
    m, own, pieces = seen["m"], seen["own"], lm.Pieces(MODEL)
    tokens = {i: (t or "").encode().translate(LOWER).split() for i, t in rows}
    counts = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in [*ws, None])
    total, distinct = sum(counts.values()), len(counts)
    firsts = Counter()
    for w, n in counts.items():
        firsts[lm._END if w is None else pieces.encode([w.decode()])[0][0]] += n
    assert all(own.first[i] == n for i, n in firsts.items())
    for i, ws in tokens.items():
        each = [pieces.encode([w.decode()])[0] for w in ws]
        words = lm.Words(np.concatenate([*each, np.zeros(0, int)]).astype(int), np.array([len(e) for e in each], int))
        log = brute_tokens(m, own, words, np.arange(len(ws)), np.array([len(ws)]))
        want = np.zeros(len(lm.WEIGHTS))
        for k, w in enumerate([*ws, None]):
            base = (counts[w] + 0.5) / (total + 0.5 * (distinct + 1))
            rest = 1.0
            if w is not None:
                ids = each[k]
                spelled = math.exp(sum(own.on[b] + own.go[a] for a, b in zip(ids, ids[1:])) + own.stop[ids[-1]])
                known = own.first[ids[0]]
                rest = (1 - lm.SPELLED) * counts[w] / known + lm.SPELLED * spelled if known else lm.SPELLED * spelled * math.exp(own.strange)
            model = math.exp(log[k]) * rest
            want += [math.log(x * base + (1 - x) * model) for x in lm.WEIGHTS]
        assert math.isclose(got[i], (np.logaddexp.reduce(want) - math.log(len(want))) / math.log(10), rel_tol=2e-3, abs_tol=2e-3)


def test_scores_do_not_depend_on_partitions_and_learn(spark):
    rng = np.random.default_rng(9)
    halves = [[f"{a}{b}" for a in x for b in "qrstvwz"] for x in ("abcdef", "ghijkl")]  # texts use one half of the words each
    rows = [(i, " ".join(rng.choice(halves[i % 2], 40))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    first = {r.doc_id: r for r in lm.scores(df.repartition(1), MODEL, chunk=8000).collect()}
    again = {r.doc_id: r.score for r in lm.scores(df.repartition(7, "text"), MODEL, chunk=8000).collect()}
    assert all(math.isclose(r.score, again[i], rel_tol=1e-9) for i, r in first.items())
    held = [r for r in first.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", 1, "x"), (1, "a b", 2, "y"), (None, "c", 3, "z"), (None, None, 4, "z")], "doc_id long, text string, chunk int, words string")
    rows = lm.scores(df, MODEL).collect()
    assert len(rows) == 4 and len({r.score for r in rows if r.doc_id == 1}) == 1


def test_other_id_types(spark):
    df = spark.createDataFrame([("a", "one two"), ("b", "two")], "doc_id string, text string")
    assert {r.doc_id for r in lm.scores(df, MODEL).collect()} == {"a", "b"}


def test_no_training_documents(spark):
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1]
    df = spark.createDataFrame([(i, "some words here") for i in held], "doc_id long, text string")
    rows = lm.scores(df, MODEL).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)


def test_empty_table(spark):
    assert lm.scores(spark.createDataFrame([], "doc_id long, text string"), MODEL).count() == 0


def test_every_id_of_training_documents_is_counted(spark):
    rows = texts()
    packed = lm.chunks(spark.createDataFrame(rows, "doc_id long, text string"), MODEL, "doc_id", "text", 500).collect()
    assert sum(len(r.ids) for r in packed) == len(rows) and len({r.chunk for r in packed}) == len(packed)
    first = sum(t["first"] for r in packed for t in r.tally)
    assert first == sum(len((t or "").encode().split()) for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1)
