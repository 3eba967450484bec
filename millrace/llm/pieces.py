"""SentencePiece encoding and decoding for merge-type vocabularies, and count-only Viterbi for unigram ones.

Both work on units: a run of the space mark and what follows it up to the next one. A vocabulary in which no piece
continues past the start of a unit (checked when it is loaded) never joins two units, so a text's result is its
units' results one after another, and repeated units are looked up. A vocabulary without that property is handled
with the whole text as its one unit.

Ids are those of the library, against which each new unit of the agenda is held. A model's own normalisation applies
through the library; a text whose model puts no mark first, or drops white space at the ends, goes to it whole. The count
of pieces reads a merge-type vocabulary as a unigram one, with ranks as scores, so it is the count of the best
segmentation and not that of any tokenizer's own encoding.

Null texts count as empty: no ids, an empty decoded text, no pieces. Repeated rows are each encoded, with equal results;
very long texts are encoded whole; an empty table gives no rows. ``digests`` and ``token_counts`` ignore columns besides
those named; ``encode`` keeps them, and gives its own columns underscores where their names are taken.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import math
import re

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import REMEMBERING, release, slices

MARK = "▁"
#: Units whose ids, and whose counts, a worker remembers. At the bound counts start anew; of ids, those that were needed
#: since half as many were new stay.
REMEMBER, COUNTED = 300_000, 1_000_000
_UNIT = re.compile(" *[^ ]+| +$")


class Vocabulary:
    """Pieces, scores and kinds of a SentencePiece model file."""

    def __init__(self, path: str):
        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.vocab_size()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if lib.is_byte(i)}
        special = set(self.bytes.values())
        self.special = special | {i for i in range(n) if lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in self.special}
        self.scores = [lib.get_score(i) for i in range(n)]
        self.unknown = lib.unk_id()
        self.splits = all(re.fullmatch(f"{MARK}*[^{MARK}]*", p) for p in self.ids)
        #: Whether the model puts a mark first and keeps all spaces, so that units are encoded by themselves.
        self.plain = MARK in self.ids and all(lib.encode(t) == [i for u in self.units(t) for i in (lib.encode(u) if u else [self.ids[MARK]])] for t in ("a b", " a  b ", "  ", f"a{MARK}b c"))

    def units(self, text: str) -> list[str]:
        """Units of a text with plain spaces for marks, each without its first one."""
        if not text:
            return []
        text = text.replace(MARK, " ")
        if not self.splits:
            return [text]
        words = text.split(" ")
        return words if "" not in words else [u[1:] for u in _UNIT.findall(" " + text)]


class Pairs:
    """What neighbouring symbols make, and how soon, for arrays of pairs.

    Symbols are ids of pieces, then characters of pieces that are none themselves, then one for every other character and
    ``none``, which is no symbol. A pair's entry is the rank of its cost above ``RANK`` bits and the piece it makes below
    ``PLACE`` bits; between them is room for the pair's place, so that the least of a unit's entries is the pair to merge.
    """

    PLACE, RANK = 20, 42
    NEVER, EMPTY = 1 << 62, -1

    def __init__(self, ids: dict[str, int], cost: dict[str, float], n: int):
        symbols = ids | {c: n + k for k, c in enumerate(sorted(set().union(*ids) - ids.keys()))}
        self.pieces, self.other, self.none = n, n + len(symbols) - len(ids), n + len(symbols) - len(ids) + 1
        self.fits = self.none < 1 << self.PLACE
        self.single = np.full(0x110000, self.other, np.int32)
        for c, i in symbols.items():
            if len(c) == 1:
                self.single[ord(c)] = i
        rank = {c: r for r, c in enumerate(sorted(set(cost.values())))}
        made = {}
        for p, i in ids.items():
            for k in range(1, len(p)):
                if (a := symbols.get(p[:k])) is not None and (b := symbols.get(p[k:])) is not None:
                    made[a * (self.none + 1) + b] = rank[cost[p]] << self.RANK | i
        # open addressing, an eighth full at most
        self.bits = max(8 * len(made), 2).bit_length()
        self.keys, self.entries = np.full(1 << self.bits, self.EMPTY, np.int64), np.full(1 << self.bits, self.NEVER, np.int64)
        for key, slot in zip(made, self._slots(np.fromiter(made, np.int64, len(made))).tolist()):
            while self.keys[slot] != self.EMPTY:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.keys[slot], self.entries[slot] = key, made[key]

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def entry(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Entries of pairs, ``NEVER`` where they make no piece."""
        keys = a * np.int64(self.none + 1) + b
        slots = self._slots(keys)
        there = self.keys[slots]
        out = np.where(there == keys, self.entries[slots], self.NEVER)
        left = np.flatnonzero((there != keys) & (there != self.EMPTY))
        while left.size:
            slots[left] = (slots[left] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slots[left]]
            hit = there == keys[left]
            out[left[hit]] = self.entries[slots[left[hit]]]
            left = left[~hit & (there != self.EMPTY)]
        return out


class Merger:
    """Score-ordered agenda of adjacent symbol pairs: best score first, leftmost among equals."""

    #: Units of more symbols keep their agenda in a heap; below that, a list of each pair's cost is faster to search.
    LONG = 48
    #: Units of about one length, so many at least and at most, are merged together, a pair of each at a time.
    MANY, TOGETHER = 100, 10_000
    WIDTHS = (6, 8, 10, 12, 16, 24, LONG)

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.cost = {p: -vocabulary.scores[i] for p, i in vocabulary.ids.items()}
        #: Text of ids that decode to the same whatever is next to them.
        self.plain = {i: p.replace(MARK, " ") for p, i in vocabulary.ids.items()} | {i: chr(b) for b, i in vocabulary.bytes.items() if b < 128}
        self.pairs = Pairs(vocabulary.ids, self.cost, len(vocabulary.pieces))

    def encode_all(self, units: list[str]) -> list[list[int]]:
        """Ids of each unit."""
        if len(units) < self.MANY or not self.pairs.fits:
            return list(map(self.encode, units))
        out: list = [None] * len(units)
        sizes = np.fromiter(map(len, units), np.int64, len(units)) + 1
        groups = np.searchsorted(self.WIDTHS, sizes)
        for g in range(len(self.WIDTHS) + 1):
            places = np.flatnonzero(groups == g)
            if g == len(self.WIDTHS) or len(places) < self.MANY:
                for i in places.tolist():
                    out[i] = self.encode(units[i])
                continue
            wide = self.WIDTHS[g]
            step = min(self.TOGETHER, (1 << Pairs.RANK - Pairs.PLACE) // (wide + 1))
            for start in range(0, len(places), step):
                some = places[start : start + step]
                for i, ids in zip(some.tolist(), self._together([units[i] for i in some.tolist()], sizes[some], wide)):
                    out[i] = ids
        return out

    def _together(self, units: list[str], sizes: np.ndarray, wide: int) -> list[list[int]]:
        """Ids of units of so many symbols, their marks included, and ``wide`` at most.

        Column by column a unit's symbols, and entries of their pairs at the left symbol's place. In every round each unit
        merges its first pair, and the pairs on both sides of what that makes get new entries. The row below the last is
        the neighbour of symbols at either end.
        """
        pairs, n = self.pairs, len(units)
        characters = (MARK + MARK.join(units)).replace(" ", MARK)
        symbols = np.full((n, wide + 1), pairs.none, np.int64)
        symbols[np.arange(wide + 1) < sizes[:, None]] = pairs.single[np.frombuffer(characters.encode("utf-32-le"), np.uint32)]
        symbols = symbols.T.ravel()
        at = np.arange(wide * n)
        after, before = np.arange(n, (wide + 2) * n), np.arange(-n, wide * n)
        before[:n] += (wide + 1) * n
        entries = np.full((wide + 1) * n, pairs.NEVER)
        entries[: wide * n] = pairs.entry(symbols[: wide * n], symbols[n:]) + (at << pairs.PLACE)
        rows = entries.reshape(wide + 1, n)[:wide]
        while True:
            first = rows.min(axis=0)
            first = first[first < pairs.NEVER]
            if not first.size:
                break
            left = (first >> pairs.PLACE) & ((1 << pairs.RANK - pairs.PLACE) - 1)
            made = first & ((1 << pairs.PLACE) - 1)
            right = after[left]
            beyond, behind = after[right], before[left]
            symbols[left], symbols[right], entries[right] = made, pairs.none, pairs.NEVER
            after[left], before[beyond] = beyond, left
            places = np.concatenate([left, behind])
            entries[places] = pairs.entry(np.concatenate([made, symbols[behind]]), np.concatenate([symbols[beyond], made])) + (places << pairs.PLACE)
        symbols = symbols.reshape(wide + 1, n).T
        of, place = np.nonzero(symbols != pairs.none)
        found = symbols[of, place]
        ids, ends = found.tolist(), np.bincount(of, minlength=n).cumsum().tolist()
        out = [ids[a:b] for a, b in itertools.pairwise([0, *ends])]
        loose = np.flatnonzero(found >= pairs.pieces)[::-1]  # from the last on, so that places of those before hold
        for i, k, j in zip(of[loose].tolist(), place[loose].tolist(), loose.tolist()):
            j -= ends[i - 1] if i else 0
            out[i][j : j + 1] = self._fallback([units[i][k - 1] if k else MARK])
        return out

    def encode(self, unit: str) -> list[int]:
        symbols = [MARK, *unit.replace(" ", MARK)]
        ids = self.v.ids
        try:
            return [ids[s] for s in (self._short(symbols) if len(symbols) <= self.LONG else self._long(symbols))]
        except KeyError:
            return self._fallback(symbols)

    def _short(self, symbols: list[str]) -> list[str]:
        """Merges in place."""
        get, never = self.cost.get, math.inf
        costs = [get(a + b, never) for a, b in itertools.pairwise(symbols)]
        while costs:
            best = min(costs)
            if best == never:
                break
            i = costs.index(best)
            symbols[i] += symbols.pop(i + 1)
            costs.pop(i)
            if i:
                costs[i - 1] = get(symbols[i - 1] + symbols[i], never)
            if i < len(costs):
                costs[i] = get(symbols[i] + symbols[i + 1], never)
        return symbols

    def _long(self, symbols: list[str]) -> list[str]:
        """Merges in place."""
        get, n = self.cost.get, len(symbols)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        agenda = [(c, i, i + 1, pair) for i in range(n - 1) if (c := get(pair := symbols[i] + symbols[i + 1])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, left, right, pair = heapq.heappop(agenda)
            if not symbols[left] or not symbols[right] or after[left] != right or symbols[left] + symbols[right] != pair:
                continue
            symbols[left], symbols[right] = pair, ""
            after[left] = after[right]
            if after[right] < n:
                before[after[right]] = left
            for a, b in ((before[left], left), (left, after[left])):
                if a >= 0 and b < n and (c := get(pair := symbols[a] + symbols[b])) is not None:
                    heapq.heappush(agenda, (c, a, b, pair))
        symbols[:] = filter(None, symbols)
        return symbols

    def _fallback(self, symbols: list[str]) -> list[int]:
        """Ids of merged symbols of which some are no pieces."""
        v, out = self.v, []
        for s in symbols:
            if (i := v.ids.get(s)) is not None:
                out.append(i)
            elif v.bytes:
                out.extend(v.bytes[b] for b in s.encode())
            else:
                out.append(v.unknown)
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of the ids, the first space mark included as a space."""
        try:
            return "".join([self.plain[i] for i in ids])
        except KeyError:
            pass
        v, out, held = self.v, [], bytearray()
        for i in ids:
            if i in v.special and self.v.library.is_byte(i):
                held.append(int(v.pieces[i][3:5], 16))
                continue
            if held:
                out.append(_from_bytes(bytes(held)))
                held.clear()
            if i == v.unknown:
                out.append(" ⁇ ")
            elif i not in v.special:
                out.append(v.pieces[i].replace(MARK, " "))
        if held:
            out.append(_from_bytes(bytes(held)))
        return "".join(out)


def _from_bytes(raw: bytes) -> str:
    """UTF-8 with one replacement character for each byte that fits nowhere."""
    out = []
    while raw:
        try:
            out.append(raw.decode())
            break
        except UnicodeDecodeError as e:
            out.append(raw[: e.start].decode())
            out.append("�")
            raw = raw[e.start + 1 :]
    return "".join(out)


class Encoder:
    """Encodes texts by units, each new unit through the agenda, in batches held against the library."""

    def __init__(self, path: str):
        self.merger = Merger(Vocabulary(path))
        self.names = [str(i) for i in range(len(self.merger.v.pieces))]
        self.coded: dict[str, str] = {}
        #: Ids of units that were last needed before as many others were new.
        self.earlier: dict[str, str] = {}
        #: Decoded text of the units that don't come back as a space and themselves.
        self.odd: dict[str, str] = {}
        #: Units on which the agenda and the library differed; the library's ids hold.
        self.differing: set[str] = set()

    def learn(self, units: set[str]) -> None:
        units = list(units)
        library, names, decode = self.merger.v.library, self.names, self.merger.decode
        # a unit is a text of its own to the library, which puts the first mark before it; the empty unit's mark stands alone
        each = library.encode(units, num_threads=1) if units else []
        if not self.merger.v.plain:  # whole texts
            for unit, known in zip(units, each):
                self.coded[unit], self.odd[unit] = ",".join(map(str, known)), " " + library.decode(known)
            return
        for unit, known, ids in zip(units, each, self.merger.encode_all(units)):
            if unit and ids != known:
                self.differing.add(unit)
                ids = known
            self.coded[unit] = ",".join([names[i] for i in ids])
            if (text := decode(ids)) != " " + unit:
                self.odd[unit] = text

    def forget(self) -> None:
        for known in (self.coded, self.earlier, self.odd, self.differing):
            known.clear()

    def age(self, n: int) -> None:
        """Make room for so many more units."""
        if len(self.coded) + n <= REMEMBER // 2:
            return
        self.earlier, self.coded = self.coded, {}
        self.odd = {u: text for u, text in self.odd.items() if u in self.earlier}
        self.differing &= self.earlier.keys()

    def differ(self, units: list[str]) -> int:
        """Units, repeats included, whose ids are the library's and not the agenda's."""
        return sum(map(self.differing.__contains__, units)) if self.differing else 0

    def encode(self, texts: list[str]) -> list[list[str]]:
        """Units of each text; ``coded`` then has the ids of each, joined by commas, and ``text`` decodes them."""
        each = [self.merger.v.units(t) if self.merger.v.plain else [t] if t else [] for t in texts]
        seen = set().union(*each)
        self.age(len(seen.difference(self.coded)))
        if missing := seen.difference(self.coded):
            for u in missing.intersection(self.earlier):
                self.coded[u] = self.earlier[u]
            self.learn(missing.difference(self.coded))
        return each

    def text(self, units: list[str]) -> str:
        """Decoded text without the space that the encoder put first."""
        if not self.odd or self.odd.keys().isdisjoint(units):
            return " ".join(units)
        odd = self.odd
        return "".join([odd[u] if u in odd else " " + u for u in units])[1:]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
        REMEMBERING.append(_encoders[path])
    return _encoders[path]


def _some(texts: list[str], limit: int = 1 << 18):
    """Texts in turns of about ``limit`` characters."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= limit:
            yield texts[start : i + 1]
            start, held = i + 1, 0
    if start < len(texts):
        yield texts[start:]


def encode(docs: DataFrame, model: str, text: str = "text", ids: str = "ids", decoded: str | None = "decoded") -> DataFrame:
    """Every column of ``docs`` plus the ids (array of int) and, if asked for, the decoded text.

    Null texts count as empty: no ids, empty decoded text. New columns get underscores where their names are taken.
    """
    while ids in docs.columns:
        ids += "_"
    while decoded and decoded in docs.columns:
        decoded += "_"
    added = [T.StructField(ids, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded, T.StringType())] if decoded else [])
    return _mapped(docs, model, text, added, lambda units, code: [_numbers(",".join(map(code.coded.__getitem__, units))), *([code.text(units)] if decoded else [])])


def _numbers(joined: str) -> np.ndarray:
    return np.array(joined.split(","), np.int32) if joined else np.zeros(0, np.int32)


def digests(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """Per document: doc_id, n_tokens, SHA-256 of its ids and of its decoded text, n_differing and, if asked for, the ids.

    ``n_differing`` counts its units on which the agenda differed from the library, whose ids hold. Null texts count as empty.
    """
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("n_differing", T.LongType())]
    added += [T.StructField("ids", T.ArrayType(T.IntegerType()))] if ids else []

    def row(units, code):
        joined = ",".join(map(code.coded.__getitem__, units))
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (joined, code.text(units))]
        return [joined.count(",") + 1 if joined else 0, *digests, code.differ(units), *([_numbers(joined)] if ids else [])]

    return _mapped(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), model, "text", added, row).drop("text")


def _mapped(docs: DataFrame, model: str, text: str, added: list, row) -> DataFrame:
    schema = T.StructType([*docs.schema.fields, *added])
    drop = text if text == "text" and any(f.name == "n_tokens" for f in added) else None
    place = docs.columns.index(text)

    def run(batches):
        code = encoder(model)
        for batch in itertools.chain.from_iterable(slices(b, text, 1 << 20) for b in batches):
            rows = [row(units, code) for units in code.encode([t or "" for t in batch.column(place).to_pylist()])]
            columns = [batch.column(i) if i != place or drop is None else pa.nulls(batch.num_rows, pa.string()) for i in range(batch.num_columns)]
            for k, f in enumerate(added):
                columns.append(pa.array([r[k] for r in rows], _ARROW[f.dataType.simpleString()]))
            yield pa.RecordBatch.from_arrays(columns, schema.names)
        release(code)  # remembered for its next task here; tasks of other stages drop it

    return docs.mapInArrow(run, schema)


_ARROW = {"bigint": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}


class Counter:
    """Piece counts of the best segmentation under a unigram vocabulary.

    Aho-Corasick lists the pieces that start at each place. The dynamic programme goes through the places in order and
    carries best score and count only. Ties follow the tokenizer: of equal scores the candidate that starts first, that
    is the longest piece, wins; and scores are single-precision numbers relative to that of the place reached, so what
    is equal depends on their rounding. A character that is no piece costs the smallest score less ten and counts as its
    bytes if the vocabulary has byte pieces, else runs of such characters count as one.
    """

    PENALTY = 10.0

    def __init__(self, path: str):
        v = self.v = Vocabulary(path)
        self.trie = ahocorasick.Automaton()
        for piece, i in v.ids.items():
            self.trie.add_word(piece, (len(piece), _single(v.scores[i])))
        self.trie.make_automaton()
        self.unknown = _single(min(v.scores) - self.PENALTY)
        self.whole = all(float(s).is_integer() for s in v.scores)  # sums below 2 ** 24 are then exact
        self.known: dict[str, int] = {}

    def count(self, unit: str) -> int:
        text = MARK + unit.replace(" ", MARK)
        n = len(text)
        starts: list[list] = [[] for _ in range(n)]
        for end, (length, score) in self.trie.iter(text):
            starts[end + 1 - length].append((end + 1, score))
        best: list = [None] * (n + 1)
        pieces, loose = [0] * (n + 1), [False] * (n + 1)
        best[0] = 0.0
        most = 0  # the last place with a score
        exact = 16777216.0 if self.whole else 0.0
        for s in range(n):
            here = best[s]
            if here:
                for e in range(s + 1, most + 1):
                    if (b := best[e]) is not None:
                        b -= here
                        best[e] = b if -exact < b < exact else _single(b)
            one = pieces[s] + 1
            found = starts[s]
            for e, score in found:
                if (b := best[e]) is None or score > b:
                    best[e], pieces[e], loose[e] = score, one, False
                    if e > most:
                        most = e
            e = s + 1
            if (not found or found[0][0] != e) and ((b := best[e]) is None or self.unknown > b):
                best[e], loose[e] = self.unknown, True
                pieces[e] = pieces[s] + (len(text[s].encode()) if self.v.bytes else int(not loose[s]))
                most = max(most, e)
        return pieces[n]

    def counts(self, texts: list[str]) -> list[int]:
        each = [self.v.units(t) for t in texts]
        seen = set().union(*each)
        if len(self.known) + len(seen) > COUNTED:
            self.known.clear()
        known = self.known
        for u in seen:
            if u not in known:
                known[u] = self.count(u)
        return [sum(map(known.__getitem__, units)) for units in each]


def _single(x: float) -> float:
    return float(np.float32(x))


_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_chars and n_tokens, the pieces of its best unigram segmentation. Null texts count as empty, with none."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("n_chars", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches):
        if model not in _counters:
            _counters[model] = Counter(model)
        counter = _counters[model]
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts: list[int] = []
            for some in _some(texts):
                counts.extend(counter.counts(some))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array(counts, pa.int64())], schema.names)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
