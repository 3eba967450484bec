"""Scores of texts under a causal self-attention model over subword ids, beside a unigram base.

Documents are dealt to chunks of about ``CHUNK`` bytes by a hash of id and text, each with its own word list. The lists'
counts are summed over the training documents of the whole corpus (pre-aggregated, joined back by word, so a hot word
costs a row a chunk), and each chunk is then scored on its own, with the counts of just its words.

The model reads SentencePiece ids. In windows of ``QUERIES`` words, each word (and the end) is predicted once: from the id
before it and from masked attention over the window's last ``KEYS`` ids up to there, so windows overlap. What is predicted
is the word's first id, by the decisions on its path through a Huffman tree over first ids, whose biases are the corpus's
counts. The rest of the word follows, given its first id, the training tokens' shares, or (``SPELLED`` of the mass) shares
of going on with each id. All ids of all training documents are learned from: every chunk trains on half of its windows,
parameters are averaged, and every chunk goes on with the other half. So trainers grow in number with the corpus. Chunks,
their order and that of their windows follow from the rows alone, so scores don't depend on partitions.

Events are those of the base: every training word, the end, and one for all words that no training text has; what the
model gives that one is the probability of the very word that occurs, which bounds the event's from below. A text's
probability is the mean, over the three weights of ``WEIGHTS``, of the product over its tokens of the base's and the
model's probability mixed with that weight.

Null and empty texts have the end only. Null ids count as held out or not by the remainder of the empty string's
checksum. Repeated rows are each scored. Very long texts make a chunk of their own. Without training documents the base
is that of no token at all and the model is the untrained one. Columns besides those named are ignored, whatever their
names; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pyspark.sql.pandas.types import to_arrow_schema

from millrace.llm.common import bucketed, materialise

CHUNK = 8 << 20
#: Words that a window predicts, ids that it sees, and width of the model.
QUERIES, KEYS, WIDTH = 24, 64, 8
#: Windows of a training step, and words scored at a time, unless one document has more.
BATCH, WORDS = 96, 20_000
ROUNDS, RATE = 2, 0.2
#: Share of a word's probability, given its first id, that is spelled.
SPELLED = 0.05
#: Weights of the base in the mixtures that a text's probability is the mean of.
WEIGHTS = (0.05, 0.3, 0.8)
#: Trainers that one task averages.
AVERAGED = 16
_UNKNOWN, _BEGIN, _END = 0, 1, 2
_LEARNED = ("e", "u", "q", "x", "c")


class Pieces:
    """The vocabulary, and ids of words."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.library.vocab_size()
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has, at least one."""
        each = [ids or [_UNKNOWN] for ids in self.library.encode(words, num_threads=1)]
        return np.fromiter(itertools.chain.from_iterable(each), np.int32), np.fromiter(map(len, each), np.int64, len(each))


def remainder(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of each range, one range after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def chunks(docs: DataFrame, model: str, doc_id: str, text: str, chunk: int = CHUNK) -> DataFrame:
    """Rows of packed documents: word list with training counts and ids, word numbers of the documents, counts of ids.

    A chunk's documents go in the order of their hash. One that outgrows ``chunk`` twice, as many copies of a row may
    make it, goes on under another number.
    """
    id_type = docs.schema[doc_id].dataType
    of_ids = T.StructType([T.StructField(n, T.LongType()) for n in ("id", "first", "on", "last", "all")])
    schema = T.StructType([
        T.StructField("chunk", T.LongType()), T.StructField("words", T.ArrayType(T.BinaryType())), T.StructField("counts", T.ArrayType(T.IntegerType())),
        T.StructField("pieces", T.BinaryType()), T.StructField("per", T.BinaryType()), T.StructField("tally", T.ArrayType(of_ids)),
        T.StructField("ids", T.ArrayType(id_type)), T.StructField("held", T.ArrayType(T.BooleanType())), T.StructField("sizes", T.ArrayType(T.IntegerType())),
        T.StructField("low", T.BinaryType()), T.StructField("high", T.BinaryType()),
    ])
    key = F.xxhash64(F.col("doc_id").cast("string"), "text")
    named = docs.select(F.col(doc_id).alias("doc_id"), remainder(F.col(doc_id)).alias("rest"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-size // chunk))
    dealt = named.withColumn("key", key).withColumn("group", F.pmod("key", F.lit(groups))).repartition("group").sortWithinPartitions("group", "key", "doc_id", "text")

    def run(batches):
        pieces = Pieces(model)
        parts, size, group, part = [], 0, None, 0

        def flush():
            held = pa.concat_arrays([p.column("rest") for p in parts]).to_numpy() == 1
            texts = pc.ascii_lower(pa.concat_arrays([p.column("text") for p in parts]).cast(pa.large_string()))
            each = pc.ascii_split_whitespace(texts)
            flat = each.flatten()
            kept = pc.greater(pc.binary_length(flat), 0)  # white space at the ends leaves empty words
            owner = each.value_parent_indices().filter(kept).to_numpy()
            coded = flat.filter(kept).dictionary_encode()
            flat, words = coded.indices.to_numpy(), coded.dictionary
            order = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
            rank = np.empty(len(words), np.int32)
            rank[order] = np.arange(len(words))
            words = words.take(pa.array(order))
            flat = rank[flat]  # frequent words get small numbers, which pack well
            trained = np.bincount(flat[~held[owner]], minlength=len(words))
            seq, per = pieces.encode(words.to_pylist())
            ends = np.cumsum(per)
            seen = np.repeat(trained > 0, per)
            first = np.zeros(len(seq), bool)
            first[ends - per] = True
            last = np.zeros(len(seq), bool)
            last[ends - 1] = True
            count = lambda which: np.bincount(seq[which], minlength=pieces.size)
            tally = [np.bincount(seq[first], trained, pieces.size).astype(np.int64), count(seen & ~first), count(seen & last), count(seen)]
            used = np.flatnonzero(tally[3])
            arrow = pa.StructArray.from_arrays([pa.array(used), *(pa.array(t[used]) for t in tally)], of_ids.names)
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            sizes = np.bincount(owner, minlength=len(held)).astype(np.int32)
            row = [
                pa.array([group + groups * part], pa.int64()), one(words.cast(pa.large_binary()).cast(pa.binary())), one(pa.array(trained.astype(np.int32))), pa.array([seq.astype(pieces.kind).tobytes()]),
                pa.array([per.astype("<u4").tobytes()]), one(arrow), one(pa.concat_arrays([p.column("doc_id") for p in parts])), one(pa.array(held)), one(pa.array(sizes)),
                pa.array([(flat & 0xFFFF).astype("<u2").tobytes()]), pa.array([(flat >> 16).astype(np.uint8).tobytes()]),
            ]
            return pa.RecordBatch.from_arrays(row, schema.names)

        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
            start = 0
            for i, (g, n) in enumerate(zip(batch.column("group").to_pylist(), lengths)):
                if (parts or i > start) and (g != group or size + n > 2 * chunk):
                    parts.append(batch.slice(start, i - start))
                    yield flush()
                    part = part + 1 if g == group else 0
                    parts, size, start = [], 0, i
                group = g
                size += n
            if start < batch.num_rows:
                parts.append(batch.slice(start))
        if parts:
            yield flush()

    return dealt.select("doc_id", "rest", "text", "group").mapInArrow(run, schema)


class Tree:
    """Huffman tree over leaves; a leaf's path is a run of ``nodes`` and of ``signs`` (1 where it goes left)."""

    def __init__(self, counts: np.ndarray):
        heap = [(float(c), i) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        n = len(counts)
        parent, sign = np.zeros(2 * n - 1, np.int64), np.ones(2 * n - 1, np.int8)
        bias = np.zeros(n - 1, np.float32)
        for k in range(n - 1):
            (a, left), (b, right) = heapq.heappop(heap), heapq.heappop(heap)
            parent[left] = parent[right] = n + k
            sign[right] = -1
            bias[k] = math.log(a / b)
            heapq.heappush(heap, (a + b, n + k))
        self.bias, top = bias, 2 * n - 2
        at, leaf, nodes, signs, leaves = np.arange(n), np.arange(n), [], [], []
        while len(at := at[(inside := at != top)]):
            leaf = leaf[inside]
            nodes.append(parent[at] - n)
            signs.append(sign[at])
            leaves.append(leaf)
            at = parent[at]
        owner = np.concatenate([*leaves, np.zeros(0, np.int64)])
        order = np.argsort(owner, kind="stable")
        self.nodes = np.concatenate([*nodes, np.zeros(0, np.int64)])[order].astype(np.uint16 if n < 1 << 16 else np.int32)
        self.signs = np.concatenate([*signs, np.zeros(0, np.int8)])[order].astype(np.float32)
        self.lengths = np.bincount(owner, minlength=n)
        self.starts = np.cumsum(self.lengths) - self.lengths


class Language:
    """What counting gives: embedding row, leaf and tree of first ids, and shares of how words go on."""

    def __init__(self, first: np.ndarray, on: np.ndarray, last: np.ndarray, all_: np.ndarray):
        size = len(first)
        used = np.flatnonzero((all_ > 0) | (np.arange(size) == _BEGIN))
        self.row = np.zeros(size, np.int32)  # row 0 stands for ids that no training word has
        self.row[used] = 1 + np.arange(len(used))
        self.rows = 1 + len(used)
        begins = np.flatnonzero((first > 0) | (np.arange(size) == _END))
        self.leaf = np.full(size, len(begins), np.int32)  # the last leaf stands for ids that begin no training word
        self.leaf[begins] = np.arange(len(begins))
        self.tree = Tree(np.r_[first[begins] + 0.5, 0.5])
        self.first = first
        self.strange = -math.log(max(1, size - len(begins)))
        self.on = np.log((on + 0.5) / (on.sum() + 0.5 * size))
        self.stop = np.log((last + 0.5) / (all_ + 1))
        self.go = np.log((all_ - last + 0.5) / (all_ + 1))

    def rest(self, ids: np.ndarray, per: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Log probability of words, of given ids and counts, when their first id is known."""
        starts = np.cumsum(per) - per
        steps = self.on[ids]
        steps[1:] += self.go[ids[:-1]]
        steps[starts] = 0
        first = ids[starts]
        spelled = np.add.reduceat(steps, starts) + self.stop[ids[starts + per - 1]] if len(per) else np.zeros(0)
        total = self.first[first]
        share = np.divide(counts, total, out=np.zeros(len(per)), where=total > 0)
        mixed = np.logaddexp(np.log(share * (1 - SPELLED) + 1e-300), spelled + math.log(SPELLED))
        return mixed + np.where(total > 0, 0, self.strange)


class Words:
    """Ids of a chunk's words; the end has the number after theirs, the beginning the one after that."""

    def __init__(self, ids: np.ndarray, per: np.ndarray):
        self.ids, self.per = np.r_[ids, _END, _BEGIN].astype(np.int32), np.r_[per, 1, 1]
        self.offset = np.cumsum(self.per) - self.per
        self.first = self.ids[self.offset]
        self.end, self.begin = len(per), len(per) + 1

    def tokens(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Word numbers of documents, each with its end."""
        return np.insert(flat, np.cumsum(sizes), self.end)


class Windows:
    """Windows over documents given by their tokens, ``sizes`` + 1 of each."""

    def __init__(self, words: Words, tokens: np.ndarray, sizes: np.ndarray):
        bounds = np.cumsum(sizes + 1)
        starts = bounds - sizes - 1
        before = np.r_[words.begin, tokens[:-1]]
        before[starts] = words.begin
        per = words.per[before]
        self.seq = words.ids[ragged(words.offset[before], per)]
        #: First id of each token, and the place of the last id before it.
        self.target = words.first[tokens]
        self.place = (np.cumsum(per) - 1).astype(np.int32)
        count = -(-(sizes + 1) // QUERIES)
        self.query = np.repeat(starts, count) + ragged(np.zeros(len(count), np.int64), count) * QUERIES
        self.many = np.minimum(np.repeat(bounds, count) - self.query, QUERIES)
        self.base = np.repeat(self.place[starts], count)

    def __len__(self) -> int:
        return len(self.query)

    def __getitem__(self, which: np.ndarray):
        """Of some windows: queries (rows of places in the text's tokens), which of them count, ids, ids before queries, and the mask."""
        slot = np.arange(QUERIES)
        counts = slot < self.many[which][:, None]
        query = self.query[which][:, None] + np.where(counts, slot, 0)
        place = self.place[query]
        begin = self.place[self.query[which] + self.many[which] - 1][:, None] + np.int32(1 - KEYS)
        key = begin + np.arange(KEYS, dtype=np.int32)
        least = np.maximum(self.base[which][:, None] - begin, 0).astype(np.int16)
        most = np.maximum(place - begin, -1).astype(np.int16)
        slot = np.arange(KEYS, dtype=np.int16)
        mask = slot <= most[:, :, None]
        mask &= (slot >= least)[:, None, :]
        return query, counts, self.seq[np.maximum(key, 0)], self.seq[place], mask


def initial(language: Language) -> dict[str, np.ndarray]:
    """Parameters: embeddings, tree nodes, attention, and what the last id and the attended ids add to the state."""
    rng = np.random.default_rng(7)
    scale = lambda s, *shape: (rng.standard_normal(shape) * s).astype(np.float32)
    one = np.eye(WIDTH, dtype=np.float32)
    return {"e": scale(0.3, language.rows, WIDTH), "u": np.zeros((len(language.tree.bias), WIDTH), np.float32), "q": scale(0.05, WIDTH, WIDTH), "x": 0.5 * one, "c": 2 * one}


def attend(m: dict[str, np.ndarray], keys: np.ndarray, last: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
    """States of queries, and what the backward pass needs; keys and last ids are rows of the embeddings."""
    x, own = np.take(m["e"], keys, axis=0), np.take(m["e"], last, axis=0)
    flat = own.reshape(-1, WIDTH)
    asked = (flat @ m["q"]).reshape(own.shape)
    a = asked @ x.transpose(0, 2, 1)
    np.minimum(a, 30, out=a)
    np.exp(a, out=a)
    a *= mask
    a /= a.sum(axis=2, keepdims=True) + np.float32(1)  # a part of the attention goes nowhere
    pooled = a @ x
    return flat @ m["x"] + pooled.reshape(-1, WIDTH) @ m["c"], x, own, asked, a, pooled


class Paths:
    """Decisions on the way to each state's leaf: first those of the first step, by paths from the longest on, and so forth."""

    def __init__(self, tree: Tree, leaf: np.ndarray):
        n = tree.lengths[leaf]
        self.order = np.argsort((255 - n).astype(np.uint8), kind="stable")
        n, starts = n[self.order], tree.starts[leaf[self.order]]
        alive = len(n) - np.cumsum(np.bincount(n, minlength=1))[:-1]  # paths of more than 0, 1, ... steps
        ends = np.cumsum(alive)
        self.steps = [*zip((ends - alive).tolist(), ends.tolist())]
        at = np.concatenate([starts[:k] + d for d, k in enumerate(alive.tolist())]) if len(n) else starts
        self.nodes, self.signs = tree.nodes[at], tree.signs[at]

    def logits(self, m: dict[str, np.ndarray], tree: Tree, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Signed logits, of states in the order of the paths, and the nodes' parameters."""
        u, z = np.take(m["u"], self.nodes, axis=0), np.empty(len(self.nodes), states.dtype)
        for a, b in self.steps:
            np.einsum("ij,ij->i", states[: b - a], u[a:b], out=z[a:b])
        z += tree.bias[self.nodes]
        z *= self.signs
        return z, u


def log_leaf(m: dict[str, np.ndarray], tree: Tree, states: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    paths = Paths(tree, leaf)
    z = paths.logits(m, tree, states[paths.order])[0]
    odds = 1 + np.exp(np.minimum(-z, 30))
    total = np.ones(len(leaf))
    for a, b in paths.steps:
        total[: b - a] *= odds[a:b]
    back = np.empty(len(leaf))
    back[paths.order] = -np.log(total)
    return back


def rows_of(index: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct indices and the sums of their rows."""
    order = np.argsort(index, kind="stable")
    kept = index[order]
    starts = np.flatnonzero(np.r_[True, kept[1:] != kept[:-1]])
    return kept[starts], np.add.reduceat(np.take(values, order, axis=0), starts, axis=0)


def gradients(m: dict[str, np.ndarray], tree: Tree, keys: np.ndarray, last: np.ndarray, mask: np.ndarray, counts: np.ndarray, leaf: np.ndarray) -> tuple[float, dict]:
    """Loss over the queries that count, divided by their number, and its gradients; of tables as (rows, values)."""
    states, x, own, asked, a, pooled = attend(m, keys, last, mask)
    which = np.flatnonzero(counts.ravel())
    paths = Paths(tree, leaf.ravel()[which])
    which = which[paths.order]
    chosen = states[which]
    z, u = paths.logits(m, tree, chosen)
    scale = np.float32(1 / len(which))
    np.clip(z, -30, 30, out=z)
    dz = (paths.signs * scale / (-1 - np.exp(z)))[:, None]
    spread, dchosen = np.empty_like(u), np.zeros_like(chosen)
    u *= dz
    for a_, b_ in paths.steps:
        np.multiply(chosen[: b_ - a_], dz[a_:b_], out=spread[a_:b_])
        dchosen[: b_ - a_] += u[a_:b_]
    g = {"u": rows_of(paths.nodes, spread)}
    dstates = np.zeros_like(states)
    dstates[which] = dchosen
    flat = own.reshape(-1, WIDTH)
    g["x"], g["c"] = flat.T @ dstates, pooled.reshape(-1, WIDTH).T @ dstates
    down, dpooled = dstates @ m["x"].T, (dstates @ m["c"].T).reshape(pooled.shape)
    da = dpooled @ x.transpose(0, 2, 1)
    da -= np.einsum("ijk,ijk->ij", dpooled, pooled)[:, :, None]  # attention times its gradient, summed
    da *= a
    dx = a.transpose(0, 2, 1) @ dpooled
    dx += da.transpose(0, 2, 1) @ asked
    dasked = (da @ x).reshape(-1, WIDTH)
    g["q"] = flat.T @ dasked
    down += dasked @ m["q"].T
    index = np.concatenate([keys.ravel(), last.ravel()])
    g["e"] = rows_of(index.astype(np.uint16) if len(m["e"]) < 1 << 16 else index, np.concatenate([dx.reshape(-1, WIDTH), down]))
    return float(np.log1p(np.exp(-z)).sum() * scale), g


def train(m: dict[str, np.ndarray], language: Language, windows: Windows, chosen: np.ndarray, rate: float = RATE) -> dict[str, np.ndarray]:
    """A pass over the chosen windows in order; steps are scaled by the root of each row's squared gradients so far."""
    m = {n: x.copy() for n, x in m.items()}
    seen = {n: np.zeros(len(x), np.float32) for n, x in m.items()}
    row, leaf, steps = language.row, language.leaf, -(-len(chosen) // BATCH)
    for t in range(steps):
        query, counts, keys, last, mask = windows[chosen[t * BATCH : (t + 1) * BATCH]]
        _, g = gradients(m, language.tree, row[keys], row[last], mask, counts, leaf[windows.target[query]])
        pace = rate * (1 - 0.9 * t / steps)
        for n in _LEARNED:
            rows, values = g[n] if n in ("e", "u") else (slice(None), g[n])
            seen[n][rows] += np.einsum("ij,ij->i", values, values)
            m[n][rows] -= values * (pace / (np.sqrt(seen[n][rows]) + np.float32(1e-8)))[:, None]
    return m


def dumped(m: dict[str, np.ndarray]) -> bytes:
    return b"".join(m[n].tobytes() for n in _LEARNED)


def loaded(raw: bytes, language: Language) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for n in _LEARNED:
        shape = (language.rows, WIDTH) if n == "e" else (len(language.tree.bias), WIDTH) if n == "u" else (WIDTH, WIDTH)
        out[n] = np.frombuffer(raw, np.float32, math.prod(shape), at).reshape(shape).copy()
        at += out[n].nbytes
    return out


def unpacked(row: dict, kind: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of a chunk's words, how many each has, and the word numbers of its documents."""
    pieces, per = np.frombuffer(row["pieces"], kind).astype(np.int32), np.frombuffer(row["per"], "<u4").astype(np.int64)
    low, high = np.frombuffer(row["low"], "<u2").astype(np.int64), np.frombuffer(row["high"], np.uint8).astype(np.int64)
    return pieces, per, low | (high << 16)


def fit(packed: DataFrame, language: Language, kind: np.dtype) -> dict[str, np.ndarray]:
    """Parameters averaged over chunks, which each train on all windows of their training documents, a part of them a round."""
    spark = packed.sparkSession
    m = initial(language)

    def add(found: pa.Table) -> pa.Table:
        found = found.sort_by("at")
        n = found.column("windows").to_numpy()
        total = sum(np.frombuffer(p.as_py(), np.float32).astype(np.float64) * k for p, k in zip(found.column("parameters"), n.tolist()))
        return pa.table({"at": pa.array([found.column("at")[0].as_py() // AVERAGED], pa.int64()), "parameters": [(total / n.sum()).astype(np.float32).tobytes()], "windows": pa.array([int(n.sum())])})

    schema = "at long, parameters binary, windows long"
    chunks = packed.agg(F.max("chunk")).first()[0]
    for turn in range(ROUNDS if chunks is not None else 0):
        shared = spark.sparkContext.broadcast((dumped(m), language))

        def run(batches, turn=turn):
            raw, language = shared.value
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {n: batch.column(n)[i].as_py() for n in ("chunk", "pieces", "per", "low", "high")}
                    sizes = batch.column("sizes")[i].values.to_numpy().astype(np.int64)
                    learned = ~batch.column("held")[i].values.to_numpy(zero_copy_only=False)
                    ids, per, flat = unpacked(row, kind)
                    words = Words(ids, per)
                    windows = Windows(words, words.tokens(flat[np.repeat(learned, sizes)], sizes[learned]), sizes[learned])
                    chosen = np.random.default_rng(len(windows)).permutation(len(windows))[turn::ROUNDS]  # windows of one text apart
                    if len(chosen):
                        own = train(loaded(raw, language), language, windows, chosen)
                        yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]], pa.int64()), pa.array([dumped(own)]), pa.array([len(chosen)], pa.int64())], ["at", "parameters", "windows"])

        trained, left = packed.select("chunk", "pieces", "per", "low", "high", "sizes", "held").mapInArrow(run, schema), chunks + 1
        while left > AVERAGED:
            trained, left = trained.groupBy(F.expr(f"at div {AVERAGED}")).applyInArrow(add, schema), -(-left // AVERAGED)
        found = trained.collect()
        if found:
            m = loaded(add(pa.table({n: [r[n] for r in found] for n in ("at", "parameters", "windows")}))["parameters"][0].as_py(), language)
    return m


class Scorer:
    def __init__(self, m: dict[str, np.ndarray], language: Language):
        self.m, self.language = m, language

    def score(self, windows: Windows) -> np.ndarray:
        """Log probability of the first id of each token, the end included."""
        language, out = self.language, np.empty(len(windows.target))
        for first in range(0, len(windows), 8 * BATCH):
            at, states = [], []
            for start in range(first, min(first + 8 * BATCH, len(windows)), BATCH):
                query, counts, keys, last, mask = windows[np.arange(start, min(start + BATCH, len(windows)))]
                at.append(query[counts])
                states.append(attend(self.m, language.row[keys], language.row[last], mask)[0][counts.ravel()])
            at = np.concatenate(at)
            out[at] = log_leaf(self.m, language.tree, np.concatenate(states), language.leaf[windows.target[at]])
        return out


def mixed(base: np.ndarray, model: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Log probability of documents whose tokens begin at ``starts``, from the tokens' probabilities under base and model."""
    each = [np.add.reduceat(np.log(w * base + (1 - w) * model), starts) for w in WEIGHTS]
    return np.logaddexp.reduce(each) - math.log(len(WEIGHTS))


class Chunk:
    """What scoring takes of a chunk's words: ids, training counts ``c`` and log probabilities, the end's last."""

    def __init__(self, language: Language, ids: np.ndarray, per: np.ndarray, c: np.ndarray, ends: int, denominator: float):
        self.words, self.c = Words(ids, per), np.r_[c, ends]
        self.rest = np.r_[language.rest(ids, per, c), 0.0]
        self.unigram = np.log(self.c + 0.5) - denominator
        self.base = np.exp(self.unigram)

    def scores(self, scorer: Scorer, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of documents of word numbers: known tokens, and natural logarithms of the base and of the score."""
        tokens = self.words.tokens(flat, sizes)
        log = scorer.score(Windows(self.words, tokens, sizes)) + self.rest[tokens]
        starts = np.cumsum(sizes + 1) - sizes - 1
        return np.add.reduceat(self.c[tokens] > 0, starts, dtype=np.int64), np.add.reduceat(self.unigram[tokens], starts), mixed(self.base[tokens], np.exp(log), starts)


def scores(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10)."""
    spark = docs.sparkSession
    pieces = Pieces(model)
    kind = pieces.kind
    packed = bucketed(chunks(docs, model, doc_id, text, chunk), "chunks", "chunk")
    rows = packed.select("chunk", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "x")).select("chunk", "at", F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    counts = materialise(rows.where("n > 0").groupBy("word").agg(F.sum("n").alias("c")), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = packed.select(F.sum(F.size(F.filter("held", lambda h: ~h)))).first()[0] or 0
    train_tokens, distinct = total + ends, distinct + (ends > 0)
    tally = np.zeros((4, pieces.size))
    for i, *n in packed.select(F.explode("tally").alias("t")).select("t.*").groupBy("id").agg(*(F.sum(n) for n in ("first", "on", "last", "all"))).collect():
        tally[:, i] = n
    tally[0, _END] += ends
    language = Language(*tally)
    shared = spark.sparkContext.broadcast((dumped(fit(packed, language, kind)), language))
    known = rows.join(counts, "word").select(F.col("chunk").alias("to"), "at", "c")
    log10 = math.log(10)
    denominator = math.log(train_tokens + 0.5 * (distinct + 1))
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("held_out", T.BooleanType()), *(T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        raw, language = shared.value
        scorer, out = Scorer(loaded(raw, language), language), []
        for i in range(left.num_rows):
            row = {n: left.column(n)[i].as_py() for n in ("pieces", "per", "low", "high")}
            ids, per, flat = unpacked(row, kind)
            c = np.zeros(len(per), np.int64)
            c[right.column("at").to_numpy()] = right.column("c").to_numpy()
            chunk = Chunk(language, ids, per, c, ends, denominator)
            sizes = np.array(left.column("sizes")[i].as_py(), np.int64)
            base, score, n_known = (np.zeros(len(sizes)) for _ in range(3))
            bounds = np.r_[0, np.cumsum(sizes)]
            at = 0
            while at < len(sizes):  # documents of so many words at a time, or one
                to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + WORDS, "right")) - 1)
                n_known[at:to], base[at:to], score[at:to] = chunk.scores(scorer, flat[bounds[at] : bounds[to]], sizes[at:to])
                at = to
            many = len(sizes)
            arrays = [left.column("ids").combine_chunks()[i].values, left.column("held").combine_chunks()[i].values, pa.array(sizes + 1), pa.array(n_known.astype(np.int64)), pa.array(np.full(many, train_tokens, np.int64)), pa.array(base / log10), pa.array(score / log10)]
            out.append(pa.Table.from_arrays(arrays, schema.names))
        return pa.concat_tables(out) if out else empty

    empty = pa.Table.from_batches([], schema=to_arrow_schema(schema))
    left = packed.select("chunk", "pieces", "per", "ids", "held", "sizes", "low", "high")
    return left.groupBy("chunk").cogroup(known.groupBy("to")).applyInArrow(run, schema)
