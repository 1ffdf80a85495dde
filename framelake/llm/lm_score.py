"""Language-model scoring by masked pseudo-likelihood.

A window network predicts every token from two tokens on each side: embeddings by position, a tanh layer and a
softmax over all tokens in two levels (class, then token within the class, both from the hidden layer). The summed
conditional log-probabilities of its tokens score a document. The HEAD most frequent words are tokens of their own,
and so are TAIL groups of the other words (by hash); a word within such a group has the share it has in the corpus.

Word counts, tokens and shares come from all documents. Documents are dealt to groups of about GROUP_BYTES by a hash
of id and text, half of the groups to each of ROUNDS rounds, so every word of every document is a target once. In a
round every group improves the shared weights on its own words, in order of id and text, and the weights are averaged
in a tree, weighed by the words seen: neither depends on how the table is laid out. Only one set of weights, the
counts of the TOP words and the sums of the groups come to the driver; shares of other words are joined from the counts.

Null or empty texts, or texts of white space: no words, score 0, mean null. Texts of any length count whole. Repeated
rows, and rows that share an id, give a row each and count as often as they stand. Equal counts are ordered by the
word's hash. Extra columns are not read. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import slices, text_key, tune, write_table

#: Tokens of a class and classes; words with a token each, tokens of all other words (by hash; divides 2 ** 64).
SIZE, LEVELS = 64, 64
TAIL = SIZE
HEAD = SIZE * LEVELS - TAIL
TOKENS = HEAD + TAIL
#: Size of the hidden layer, words with counts of their own on the driver.
HIDDEN, TOP = 16, 32_768
OFFSETS = (-2, -1, 1, 2)
ROUNDS, BATCH, RATE = 2, 1024, 0.1
#: Words scored at once; text of a training group; models averaged at once.
PIECE, GROUP_BYTES, FAN = 16_384, 8 << 20, 32
#: Words counted at once; leading bits of a hash that say where among the known words it would stand.
COUNTED, LEAD = 2_000_000, 17
#: Classes of so many rows in a training step, at most, are multiplied in one call.
FEW = 8


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def counted() -> pa.RecordBatch:
        words, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    held, size = [], 0
    for batch in slices(batches, "text"):
        held.append(K.word_hashes(*K.text_bytes(batch.column("text")))[0])
        size += len(held[-1])
        if size >= COUNTED:
            yield counted()
            held, size = [], 0
    if size:
        yield counted()


class Vocabulary:
    """Token of every word, known or not, and the log share of the word within its token.

    ``counts`` (word, n), where given, has all words, and ``rest`` the summed counts of those beyond ``top`` by token.
    """

    def __init__(self, top: list[tuple[int, int]], words: int, total: int, rest: np.ndarray | None = None, counts: DataFrame | None = None) -> None:
        ids = np.array([w for w, _ in top], np.int64).view(np.uint64)
        n = np.array([c for _, c in top], np.float64)
        order = np.argsort(ids)
        self.ids = ids[order]
        self.first = np.searchsorted(self.ids, np.arange(1 << LEAD, dtype=np.uint64) << np.uint64(64 - LEAD)).astype(np.int32)
        cls = np.where(np.arange(len(ids)) < HEAD, np.arange(len(ids)), HEAD + (ids % np.uint64(TAIL)).astype(np.int64))
        unknown_words, unknown = max(words - len(ids), 1), max(total - n.sum(), 1.0)
        mass = np.bincount(cls, n, TOKENS) + (np.where(np.arange(TOKENS) >= HEAD, unknown / TAIL, 0.0) if rest is None else rest)
        self.mass, self.counts = mass, counts
        self.classes = cls[order].astype(np.int16)
        self.share = np.log(n / mass[cls])[order] if len(ids) else np.zeros(0)
        rare = unknown / unknown_words
        with np.errstate(divide="ignore"):
            self.rare = np.log(np.where(np.arange(TOKENS) >= HEAD, rare / np.maximum(mass, rare), 1.0))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"counts": None}

    def place(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words stand among those with counts of their own here, and whether they are among these."""
        if not len(self.ids):
            return np.zeros(len(hashes), np.int32), np.zeros(len(hashes), bool)
        last = np.int32(len(self.ids) - 1)
        at = np.minimum(self.first.take((hashes >> np.uint64(64 - LEAD)).astype(np.int64)), last)
        have = self.ids.take(at)
        late = np.flatnonzero((have < hashes) & (at < last))
        while len(late):
            at[late] += 1
            have[late] = self.ids[at[late]]
            late = late[(have[late] < hashes[late]) & (at[late] < last)]
        return at, have == hashes

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Whether words have counts of their own here."""
        return self.place(hashes)[1]

    def look_up(self, hashes: np.ndarray, place: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        at, known = place or self.place(hashes)
        cls, share = (x.take(at) if len(x) else np.zeros(len(at), x.dtype) for x in (self.classes, self.share))
        new = np.flatnonzero(~known)
        cls[new] = HEAD + (hashes[new] % np.uint64(TAIL)).astype(np.int16)
        share[new] = self.rare[cls[new]]
        return cls, share


class Network:
    """Embeddings [position, token or edge, HIDDEN], weights and biases of the classes and of the tokens in each class."""

    def __init__(self, mass: np.ndarray | None = None, seed: int = 5) -> None:
        r = np.random.default_rng(seed)
        draw = lambda *shape: (r.standard_normal(shape) * 0.1).astype(np.float32)
        grid = np.log(np.maximum(np.ones(TOKENS) if mass is None else mass, 0.5)).reshape(LEVELS, SIZE)
        whole = np.logaddexp.reduce(grid, axis=1)
        # Biases start at the shares of the tokens in the corpus.
        self.parts = [draw(len(OFFSETS), TOKENS + 1, HIDDEN), draw(HIDDEN, LEVELS), (whole - np.logaddexp.reduce(whole)).astype(np.float32), draw(LEVELS, HIDDEN, SIZE), (grid - whole[:, None]).astype(np.float32)]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parts])

    @classmethod
    def of(cls, values: np.ndarray) -> Network:
        out, at = cls.__new__(cls), 0
        out.parts = []
        for shape in ((len(OFFSETS), TOKENS + 1, HIDDEN), (HIDDEN, LEVELS), (LEVELS,), (LEVELS, HIDDEN, SIZE), (LEVELS, SIZE)):
            n = int(np.prod(shape))
            out.parts.append(values[at : at + n].astype(np.float32).reshape(shape))
            at += n
        return out

    def _joined(self, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Embeddings of all positions in one list; weights of the classes and of their tokens, each with its biases as last row."""
        e, w1, b1, w2, b2 = parts
        return e.reshape(-1, HIDDEN), np.concatenate([w1, b1[None]]), np.concatenate([w2, b2[:, None]], axis=1)

    def log_probability(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        e, w1, w2 = self._joined(self.parts)
        place = context + STEPS
        out = np.empty(len(target), np.float32)
        for s in range(0, len(target), PIECE):
            level, token = np.divmod(target[s : s + PIECE].astype(np.int16), np.int16(SIZE))
            order = np.argsort(level, kind="stable")
            level, token = level[order], token[order]
            h = _hidden(e, place[:, s : s + PIECE][:, order])[0][: len(level)]
            one = _log_share(h @ w1, level)
            ends = np.cumsum(np.bincount(level, minlength=LEVELS)).tolist()
            z = np.empty((len(h), SIZE), np.float32)
            for k, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
                if a < b:
                    np.dot(h[a:b], w2[k], out=z[a:b])
            out[s + order] = one + _log_share(z, token)
        return out

    def improve(self, context: np.ndarray, target: np.ndarray, squares: list[np.ndarray], rate: float = RATE) -> None:
        """One pass of gradient steps, each scaled by the ``squares`` of the gradients so far, which grow."""
        e, w1, w2 = self._joined(self.parts)
        size_e, size1, size2 = self._joined(squares)
        # Rows of embeddings as one value each, which are written faster.
        whole = [x.view(f"V{x.itemsize * HIDDEN}")[:, 0] for x in (e, size_e)]
        # Rows of a step stand in order of their class. Sorted as short numbers, which is far faster.
        level, token = np.divmod(target.astype(np.int16), np.int16(SIZE))
        turn = np.arange(len(target)) // BATCH
        order = np.argsort((turn % 512 * LEVELS + level).astype(np.uint16), kind="stable")
        if len(turn) and turn[-1] >= 512:
            order = order[np.argsort(turn[order], kind="stable")]
        level, token, place = level[order], token[order], (context + STEPS).astype(np.uint16)[:, order]
        counts = np.bincount(turn * LEVELS + level, minlength=LEVELS * (len(target) // BATCH + 1)).reshape(-1, LEVELS)
        ends = counts.cumsum(axis=1)
        begins, nth = ends - counts, np.arange(FEW)
        some, held = np.empty((LEVELS, HIDDEN + 1, SIZE), np.float32), np.empty((LEVELS, HIDDEN + 1, SIZE), np.float32)
        p, q = np.empty((BATCH, SIZE), np.float32), np.empty((BATCH + 1, SIZE), np.float32)
        left = np.empty((BATCH + 1, HIDDEN), np.float32)

        def descend(weights: np.ndarray, size: np.ndarray, gradient: np.ndarray, held: np.ndarray) -> None:
            np.multiply(gradient, gradient, out=held)
            np.add(size, held, out=size)
            np.add(size, np.float32(1e-10), out=held)
            np.sqrt(held, out=held)
            np.divide(gradient, held, out=held)
            np.multiply(held, np.float32(rate), out=held)
            np.subtract(weights, held, out=weights)

        for i, s in enumerate(range(0, len(target), BATCH)):
            at = place[:, s : s + BATCH]
            n = at.shape[1]
            part, line = np.float32(1 / n), np.arange(n) * SIZE
            h, back = _hidden(e, at)
            scaled = h * part
            one = _softmax(np.matmul(h[:n], w1, out=p[:n]))
            one.reshape(-1)[line + level[s : s + BATCH]] -= 1.0
            slope = one @ w1[:HIDDEN].T
            # One product for each class, for those of FEW rows at most in one call; all else for all classes at once.
            # Rows that fill up are row n, a row of zeros. Classes without rows keep what they have.
            few = np.flatnonzero((counts[i] > 0) & (counts[i] <= FEW))
            rows = np.where(nth < counts[i, few, None], begins[i, few, None] + nth, n).ravel()
            many = [(k, slice(begins[i, k], ends[i, k])) for k in np.flatnonzero(counts[i] > FEW).tolist()]
            short, weights = h.take(rows, axis=0).reshape(len(few), FEW, HIDDEN + 1), w2.take(few, axis=0)
            for k, r in many:
                np.dot(h[r], w2[k], out=q[r])
            q[rows] = (short @ weights).reshape(len(rows), SIZE)
            two = _softmax(q[:n])
            two.reshape(-1)[line + token[s : s + BATCH]] -= 1.0
            some[counts[i] == 0] = 0.0
            for k, r in many:
                np.dot(q[r], w2[k, :HIDDEN].T, out=left[r])
                np.dot(scaled[r].T, q[r], out=some[k])
            back_short = q.take(rows, axis=0).reshape(len(few), FEW, SIZE)
            left[rows] = (back_short @ weights[:, :HIDDEN].transpose(0, 2, 1)).reshape(len(rows), HIDDEN)
            some[few] = (short * part).transpose(0, 2, 1) @ back_short
            gradient = scaled[:n].T @ one
            descend(w1, size1, gradient, np.empty_like(gradient))
            descend(w2, size2, some, held)
            slope += left[:n]
            back *= back
            np.subtract(1.0, back, out=back)
            back *= slope
            back *= part
            # Positions have tokens of their own, so each is sorted by itself.
            order = np.argsort(at, axis=1, kind="stable").ravel()
            at = np.sort(at, axis=1, kind="stable").ravel()
            new = np.ones(len(at), bool)
            np.not_equal(at[1:], at[:-1], out=new[1:])
            new = np.flatnonzero(new)
            # Summed in pairs of neighbouring columns, which takes half the steps.
            gradient = np.add.reduceat(back.take(order, axis=0).view(np.complex64), new, axis=0).view(np.float32)
            at = at[new].astype(np.int64)
            own = [x.take(at, axis=0) for x in (e, size_e)]
            descend(*own, gradient, np.empty_like(gradient))
            for rows, new in zip(whole, own, strict=True):
                np.put(rows, at, new.view(rows.dtype)[:, 0], mode="clip")
        for parts, one, two in ((self.parts, w1, w2), (squares, size1, size2)):
            for part, new in zip(parts[1:], (one[:HIDDEN], one[HIDDEN], two[:, :HIDDEN], two[:, HIDDEN]), strict=True):
                part[...] = new


#: Where the embeddings of each position begin in the list of all; sums of rows are products with ones.
STEPS, ONES = np.arange(len(OFFSETS), dtype=np.int16)[:, None] * np.int16(TOKENS + 1), np.ones(SIZE, np.float32)


def _hidden(e: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hidden layer with 1 for the biases and a row of zeros at the end, and by itself."""
    n = place.shape[1]
    each = e.take(place.ravel(), axis=0, mode="clip").reshape(len(OFFSETS), n, HIDDEN)
    own = each[0] + each[1]
    for one in each[2:]:
        own += one
    np.tanh(own, out=own)
    out = np.ones((n + 1, HIDDEN + 1), np.float32)
    out[:n, :HIDDEN] = own
    out[n] = 0.0
    return out, own


def _shift(z: np.ndarray) -> None:
    """Lower rows whose powers might leave the range of floats."""
    if z.size and (z.max() > 60 or z.min() < -60):
        z -= z.max(axis=1, keepdims=True)


def _log_share(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Logarithm of the softmax of each row, at one column of each."""
    _shift(z)
    own = z[np.arange(len(z)), at]
    np.exp(z, out=z)
    return own - np.log(z @ ONES)


def _softmax(z: np.ndarray) -> np.ndarray:
    _shift(z)
    np.exp(z, out=z)
    z *= (1 / (z @ ONES))[:, None]
    return z


def contexts(cls: np.ndarray, border: np.ndarray) -> np.ndarray:
    """Tokens at OFFSETS around every word; TOKENS stands beyond the ends of its text."""
    n = len(cls)
    doc = np.repeat(np.arange(len(border) - 1, dtype=np.int32), np.diff(border))
    out = np.full((len(OFFSETS), n), TOKENS, cls.dtype)
    for k, o in enumerate(OFFSETS):
        lo, hi = max(0, -o), min(n, n - o)
        if hi > lo:
            same = doc[lo:hi] == doc[lo + o : hi + o]
            np.copyto(out[k, lo:hi], cls[lo + o : hi + o], where=same)
    return out


def _rest(counts: DataFrame, top: list) -> np.ndarray:
    """Summed counts of the words beyond ``top`` by token; TAIL divides 2 ** 64, so signs of hashes don't matter."""
    out = np.zeros(TOKENS)
    for r in counts.groupBy(F.pmod("word", F.lit(TAIL)).alias("c")).agg(F.sum("n").alias("n")).collect():
        out[HEAD + r["c"]] = r["n"]
    for r in top:
        out[HEAD + r["word"] % TAIL] -= r["n"]
    return out


def _trainer(shared) -> Callable[[pa.Table], pa.Table]:  # noqa: ANN001
    """Weights that a group of documents makes of the shared ones, and the words it saw."""

    def run(table: pa.Table) -> pa.Table:
        words, own = shared.value[0], Network.of(shared.value[1])
        squares, seen = [np.zeros_like(x) for x in own.parts], 0
        ordered = table.sort_by([("doc_id", "ascending"), ("key", "ascending")]).select(["g", "text"])
        for batch in slices(iter(ordered.to_batches()), "text"):
            hashes, border = K.word_hashes(*K.text_bytes(batch.column("text")))
            tokens, _ = words.look_up(hashes)
            mixed = np.random.default_rng(len(tokens)).permutation(len(tokens))
            own.improve(contexts(tokens, border)[:, mixed], tokens[mixed], squares)
            seen += len(tokens)
        return pa.table({"g": table.column("g").slice(0, 1), "n": pa.array([seen], pa.int64()), "w": pa.array([own.flat().tobytes()], pa.binary())})

    return run


def _mean(table: pa.Table) -> pa.Table:
    """The mean of up to FAN models, weighed by the words they saw."""
    rows = sorted(table.to_pylist(), key=lambda r: r["g"])
    total = sum(r["n"] for r in rows)
    mean = sum(np.frombuffer(r["w"], np.float32).astype(np.float64) * (r["n"] / total if total else 1.0 / len(rows)) for r in rows)
    return pa.table({"g": pa.array([rows[0]["g"] // FAN], pa.int64()), "n": pa.array([total], pa.int64()), "w": pa.array([mean.astype(np.float32).tobytes()], pa.binary())})


def learn(texts: DataFrame, rounds: int = ROUNDS) -> tuple[Vocabulary, Network]:
    """Vocabulary and network from all rows of ``texts`` (doc_id, text)."""
    spark = texts.sparkSession
    counts = write_table(texts.select("text").mapInArrow(_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    size = counts.agg(F.count("*").alias("words"), F.sum("n").alias("total")).first()
    top = counts.orderBy(F.desc("n"), "word").limit(TOP).collect()
    vocabulary = Vocabulary([(r["word"], r["n"]) for r in top], size["words"], size["total"] or 0, _rest(counts, top), counts)
    network = Network(vocabulary.mass)
    if not top:
        return vocabulary, network
    bytes_ = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    each = -(-int(bytes_) // (GROUP_BYTES * rounds))
    dealt = texts.select(F.pmod(F.xxhash64("doc_id", text_key(F.col("text"))), F.lit(each * rounds)).alias("g"), "doc_id", text_key(F.col("text")).alias("key"), "text").where(F.length("text") > 0)
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast((vocabulary, network.flat()))
        part = dealt.where(F.col("g") % rounds == turn).withColumn("g", F.floor(F.col("g") / rounds))
        models, left = write_table(part.groupBy("g").applyInArrow(_trainer(shared), "g long, n long, w binary"), "models"), each
        while left > 1:
            models, left = write_table(models.groupBy(F.floor(F.col("g") / FAN).alias("up")).applyInArrow(_mean, "g long, n long, w binary"), "models"), -(-left // FAN)
        row = models.first()
        if row:
            network = Network.of(np.frombuffer(row["w"], np.float32))
    return vocabulary, network


def score(docs: DataFrame, model: tuple[Vocabulary, Network] | None = None) -> DataFrame:
    """doc_id, n_words, log_prob (sum), mean_log_prob of every row of ``docs``."""
    spark = docs.sparkSession
    tune(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    vocabulary, network = model or learn(texts)
    counts, mass, apart = vocabulary.counts, vocabulary.mass, vocabulary.counts is not None
    shared = spark.sparkContext.broadcast((vocabulary, network))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, network = shared.value
        row = TaskContext.get().partitionId() << 40
        for batch in slices(batches, "text"):
            hashes, border = K.word_hashes(*K.text_bytes(batch.column("text")))
            place = vocabulary.place(hashes)
            tokens, share = vocabulary.look_up(hashes, place)
            rare = ~place[1] if apart else np.zeros(len(hashes), bool)
            each = network.log_probability(contexts(tokens, border), tokens) + np.where(rare, 0.0, share)
            sums = np.concatenate([[0.0], np.cumsum(each, dtype=np.float64)])
            left = np.concatenate([[0], np.cumsum(rare)])[border].astype(np.int32)
            words = pa.ListArray.from_arrays(pa.array(left), pa.array(hashes[rare].view(np.int64)))
            rows = np.arange(row, row + batch.num_rows)
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(rows), batch.column("doc_id"), pa.array(np.diff(border).astype(np.int64)), pa.array(sums[border[1:]] - sums[border[:-1]]), words], names=["row", "doc_id", "n_words", "part", "words"])

    scored = write_table(texts.mapInArrow(run, "row long, doc_id long, n_words long, part double, words array<long>"), "scored")
    total = F.col("part")
    if apart:
        sizes = F.array(*[F.lit(float(m)) for m in mass[HEAD:]])
        share = F.log(F.col("n") / F.element_at(sizes, (F.pmod("word", F.lit(TAIL)) + 1).cast("int")))
        held = scored.select(F.col("row").alias("r"), F.explode("words").alias("word"))
        # Words that no document of the model has count once, as rarest. No word here is frequent, so they meet one by one.
        shares = held.join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(1))).groupBy("r").agg(F.sum(share).alias("rare"))
        scored = scored.join(shares, F.col("row") == F.col("r"), "left")
        total = total + F.coalesce("rare", F.lit(0.0))
    return scored.select("doc_id", "n_words", total.alias("log_prob"), F.when(F.col("n_words") > 0, total / F.col("n_words")).alias("mean_log_prob"))
