"""Language identification by cross-parsing entropy.

For every language a suffix automaton is built over a bounded sample of its labelled texts. A text is
parsed greedily into longest matches against each automaton; the language that needs the fewest phrases
per character wins. Texts are cut into blocks that are parsed side by side, one automaton step of all
blocks at a time, so a phrase also ends at the end of a block; every character of a text counts.

Sampling bound (the classifier's documented parameters): about DOCS documents a label, chosen by a hash of doc_id,
CHARS characters of each, TRAIN characters a language and TRAIN_ALL of all languages together. Every label that is
not null is learned and every character of the sample keeps a code of its own; automata have at most three
transitions a character, in hash tables, so they are small enough to travel with the tasks.

Null text, or text without any letter: ``und`` with score 0. Languages with a null label are not learned;
without any labelled text everything is ``und``. Texts of any length count whole. Repeated rows, and rows that share
an id, give a row each; a null id is in no fold (held_out null). Extra columns are not read. An empty table gives an
empty one. Equal phrase counts go to the language first in code point order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, text_key, tune

DOCS, CHARS, TRAIN, TRAIN_ALL = 300, 400, 60_000, 4_000_000
BLOCK, FOLDS = 1024, 5
#: Bytes of the tables of steps in a worker.
DENSE = 192 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)


def automaton(codes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transitions (state, letter, next state) of the suffix automaton over ``codes``; it starts in state 0."""
    follow: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        cur = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = cur
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(follow)
                follow.append(dict(follow[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    sizes = [len(row) for row in follow]
    pairs = np.array([x for row in follow for x in row.items()], np.int64).reshape(-1, 2)
    return np.repeat(np.arange(len(follow)), sizes), pairs[:, 0], pairs[:, 1]


class Parser:
    """The greedy parse against one automaton, for many texts a step at a time.

    State 0 stands for "between phrases": there, and where the automaton has no transition, a character begins a
    phrase. The other states are those of the automaton, whose first has the number 1. Transitions lie in an open
    hash table with linear probing; those of the ``width`` most frequent letters are also laid out as a table of
    steps, where the parse runs. That one is made where it is used and does not travel.
    """

    def __init__(self, codes: list[int], letters: int) -> None:
        state, letter, target = automaton(codes)
        self.letters = letters
        self.root = np.zeros(letters, np.int32)
        first = state == 0
        self.states, self.order = int(target.max(initial=0)) + 2, np.argsort(-np.bincount(codes or [0], minlength=letters), kind="stable")
        self.own = np.unique(np.array(codes or [0]))
        self.root[letter[first]] = target[first] + 1
        bits = max(4, int(len(state) * 2.5).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.targets = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        keys, values = (state + 1) * letters + letter, (target + 1).astype(np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] < 0)
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.keys[slot[put]], self.targets[slot[put]] = keys[put], values[put]
            left = np.ones(len(keys), bool)
            left[put] = False
            keys, values, slot = keys[left], values[left], (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * MIX) >> self.shift).view(np.int64)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_table"}

    def table(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Columns of all letters (``width``: none) and steps by state * width + column: twice the next state's row, plus 1 where a phrase begins."""
        if not hasattr(self, "_table"):
            chosen = np.unique(np.append(self.order[: width - 1], 0))
            column = np.full(self.letters, width, np.int32)
            column[chosen] = np.arange(len(chosen))
            # A letter that the language does not have begins a phrase everywhere, as code 0 does.
            column[np.setdiff1d(np.arange(self.letters), self.own)] = column[0]
            steps = np.zeros((self.states, width), np.int32)
            steps[:, : len(chosen)] = self.root[chosen] * (2 * width) + 1
            used = np.flatnonzero(self.keys >= 0)
            state, at = np.divmod(self.keys[used], self.letters)
            common = column[at] < width
            steps[state[common], column[at[common]]] = self.targets[used[common]] * (2 * width)
            self._table = column, steps.reshape(-1)
        return self._table

    def step(self, state: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states, and whether a phrase begins."""
        key = state * np.int64(self.letters) + code
        slot = self._slot(key)
        held = self.keys[slot]
        after = self.targets[slot]
        open_ = np.flatnonzero((held != key) & (held >= 0))
        while len(open_):
            at = (slot[open_] + 1) & self.mask
            slot[open_] = at
            held[open_] = found = self.keys[at]
            after[open_] = self.targets[at]
            open_ = open_[(found != key[open_]) & (found >= 0)]
        fresh = held != key
        return np.where(fresh, self.root[code], after), fresh


@lru_cache(maxsize=1)
def _letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _folded(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


class Model:
    """Parsers of all languages, small enough to travel with the task."""

    def __init__(self, samples: dict[str, list[str]], train: int = TRAIN) -> None:
        self.languages = sorted(samples)
        train = min(train, TRAIN_ALL // max(len(samples), 1))
        texts = {k: "\n".join(samples[k])[:train] for k in self.languages}
        every = np.concatenate([_folded(t) for t in texts.values()]) if texts else np.zeros(0, np.uint32)
        self.alphabet = np.unique(every)
        self.parsers = [Parser(self.encode(_folded(t)).tolist(), len(self.alphabet) + 1) for t in texts.values()]
        self.width = int(np.clip(DENSE // (4 * sum(x.states for x in self.parsers) or 1), 2, 96))

    def encode(self, points: np.ndarray) -> np.ndarray:
        """Codes of characters; 0 is any character that no sample holds."""
        if not hasattr(self, "_codes"):
            self._codes = np.zeros(0x110000, np.int32)
            self._codes[self.alphabet] = np.arange(1, len(self.alphabet) + 1)
        return self._codes[points]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_codes"}

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases [texts, languages], characters and whether a letter occurs, of every text."""
        points = [_folded(t) for t in texts]
        sizes = np.array([len(p) for p in points], np.int64)
        flat = np.concatenate(points) if points else np.zeros(0, np.uint32)
        ends = np.cumsum(sizes)
        seen = np.concatenate([[0], np.cumsum(_letter_table()[flat])])
        letters = seen[ends] > seen[ends - sizes]
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = (ends - sizes)[owner] + nth * BLOCK
        size = np.minimum(BLOCK, ends[owner] - begin)
        order = np.argsort(-size, kind="stable")
        begin, size, owner = begin[order], size[order], owner[order]
        codes = self.encode(flat).astype(np.int64)
        grid = np.zeros((BLOCK, len(owner)), np.int64)
        active = np.searchsorted(-size, -np.arange(BLOCK), side="left")
        for i in range(int(size[0]) if len(size) else 0):
            grid[i, : active[i]] = codes[begin[: active[i]] + i]
        out = np.zeros((len(texts), len(self.parsers)), np.int64)
        for j, parser in enumerate(self.parsers):
            column, steps = parser.table(self.width)
            local = column[grid]
            rare = (local == self.width).any(axis=1)
            state = np.zeros(len(owner), np.int32)
            count = np.zeros(len(owner), np.int32)
            for i in range(int(size[0]) if len(size) else 0):
                m = active[i]
                if rare[i]:
                    at = np.flatnonzero(local[i, :m] == self.width)
                    got = steps[state[:m] + np.minimum(local[i, :m], self.width - 1)]
                    after, fresh = parser.step((state[at] // self.width).astype(np.int64), grid[i, at])
                    got[at] = after * (2 * self.width) + fresh
                else:
                    got = steps[state[:m] + local[i, :m]]
                count[:m] += got & 1
                state[:m] = got >> 1
            out[:, j] = np.bincount(owner, count, len(texts)).astype(np.int64)
        return out, sizes, letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and phrases per character of the winner."""
        if not self.languages or not texts:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts))
        counts, sizes, letters = self.phrases([t or "" for t in texts])
        rate = counts / np.maximum(sizes, 1)[:, None]
        best = rate.argmin(axis=1)
        least = rate[np.arange(len(texts)), best]
        rest = np.delete(rate, 0, 1) if rate.shape[1] == 1 else np.partition(rate, 1, axis=1)[:, 1:2]
        score = 1.0 - least / np.maximum(rest[:, 0], 1e-12) if rest.shape[1] else np.ones(len(texts))
        names = [self.languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
        return names, np.where(letters, np.clip(score, 0.0, 1.0), 0.0), least


def train(docs: DataFrame, docs_a_language: int = DOCS, chars: int = CHARS) -> Model:
    """Learn from text and lang of rows outside the held-out fold.

    For each label at most as many rows of CHARS characters reach the driver as fill its share of TRAIN_ALL.
    """
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS))
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold != 0))
    counts = usable.groupBy("lang").agg(F.count("*").alias("rows"))
    each = min(docs_a_language, max(1, TRAIN_ALL // (chars * max(counts.count(), 1))))
    draw = F.pmod(F.xxhash64(F.lit("language"), F.col("doc_id")), F.lit(1 << 40)) / float(1 << 40)
    rates = counts.select(F.col("lang").alias("l"), (F.lit(2.0 * each) / F.col("rows")).alias("rate"))
    drawn = usable.select("lang", F.substring("text", 1, chars).alias("text"), draw.alias("draw")).join(F.broadcast(rates), F.col("lang") == F.col("l")).where("draw < rate")
    order = Window.partitionBy("lang").orderBy("draw", "text")
    samples: dict[str, list[str]] = {}
    for r in drawn.withColumn("n", F.row_number().over(order)).where(F.col("n") <= each).orderBy("lang", "n").collect():
        samples.setdefault(r["lang"], []).append(r["text"])
    return Model(samples)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, phrases_a_char, key (text_key) for every row of ``docs``."""
    spark = docs.sparkSession
    tune(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).withColumn("key", text_key(F.col("text")))
    shared = spark.sparkContext.broadcast(model or train(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            ids = batch.column("doc_id").to_pylist()
            names, score, rate = shared.value.predict(batch.column("text").to_pylist())
            held = [None if i is None else zlib.crc32(str(i).encode()) % FOLDS == 0 for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(held, pa.bool_()), pa.array(names, pa.string()), pa.array(score), pa.array(rate), batch.column("key")], names=["doc_id", "held_out", "lang_pred", "score", "phrases_a_char", "key"])

    return texts.select("doc_id", "text", "key").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, phrases_a_char double, key long")
