import random
from collections import Counter

import numpy as np
import pyarrow as pa
from corpus_text import prose

from framelake.llm import kernels as K
from framelake.llm import lm_score
from framelake.llm.lm_score import TOKENS, Network, Vocabulary, contexts, learn, score


def test_shares_of_all_words_sum_to_one():
    r = np.random.default_rng(2)
    ids = r.integers(0, 2**63, 400, dtype=np.uint64)
    n = np.sort(r.integers(1, 90, 400))[::-1]
    words = Vocabulary([(int(w), int(c)) for w, c in zip(ids[:300].view(np.int64), n[:300], strict=True)], 400, int(n.sum()))
    cls, share = words.look_up(ids)
    total = np.bincount(cls, np.exp(share), TOKENS)
    assert (total[cls[:300]] > 0.999).all() and (total < 4).all()


def plain(net, context):
    """Log-probabilities of all tokens, one by one."""
    e, w1, b1, w2, b2 = net.parts
    h = np.tanh(sum(e[k][context[k]] for k in range(4)).astype(np.float64))
    soft = lambda z: z - np.log(np.exp(z).sum())
    out = np.concatenate([one + soft(h @ w2[k] + b2[k]) for k, one in enumerate(soft(h @ w1 + b1))])
    assert abs(np.exp(out).sum() - 1) < 1e-6
    return out


def test_log_probabilities_are_those_of_the_formula():
    net, r = Network(), np.random.default_rng(1)
    cls = r.integers(0, TOKENS, 30)
    c = contexts(cls, np.array([0, 12, 12, 30]))
    assert c[:, 0].tolist() == [TOKENS, TOKENS, cls[1], cls[2]] and c[:, 12].tolist() == [TOKENS, TOKENS, cls[13], cls[14]] and c[:, 11].tolist()[2:] == [TOKENS, TOKENS]
    got = net.log_probability(c, cls)
    for i in range(30):
        assert abs(got[i] - plain(net, c[:, i])[cls[i]]) < 1e-3


def test_training_beats_unigrams_and_order_matters(spark):
    r = random.Random(4)
    table = {a: [r.choice("abcdefgh") + str(r.randrange(3)) for _ in range(2)] for a in [x + str(i) for x in "abcdefgh" for i in range(3)]}

    def chain(n):
        out = [r.choice(list(table))]
        while len(out) < n:
            out.append(r.choice(table[out[-1]]))
        return out

    rows = [(i, " ".join(chain(400))) for i in range(300)]
    test = [chain(400) for _ in range(8)]
    model = learn(spark.createDataFrame(rows, "doc_id long, text string"))
    shuffled = [r.sample(t, len(t)) for t in test]
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate([*test, *shuffled])], "doc_id long, text string")
    got = {x["doc_id"]: x["mean_log_prob"] for x in score(frame, model).collect()}
    real, mixed = np.mean([got[i] for i in range(8)]), np.mean([got[i] for i in range(8, 16)])
    n = Counter(w for _, t in rows for w in t.split())
    unigram = np.mean([np.log(n[w] / sum(n.values())) for t in test for w in t])
    assert real > mixed + 0.5 and real > unigram + 0.3


def test_edges(docs, texts, no_docs):
    got = score(docs).collect()
    assert len(got) == len(texts)
    by_id = {t[0]: t[1] for t in texts}
    for r in got:
        n = len(K.word_hashes(*[np.frombuffer((by_id[r["doc_id"]] or "").encode(), np.uint8), np.array([0, len((by_id[r["doc_id"]] or "").encode())])])[0])
        assert r["n_words"] == n and (r["mean_log_prob"] is None) == (n == 0)
        assert r["log_prob"] <= 1e-9 and np.isfinite(r["log_prob"])
    assert score(no_docs).collect() == []
    assert prose(1, 3)


def test_rounds_train_on_every_word_whatever_the_layout(spark, monkeypatch):
    from framelake.llm import lm_score

    monkeypatch.setattr(lm_score, "GROUP_BYTES", 3_000)
    monkeypatch.setattr(lm_score, "FAN", 2)
    seen = []
    write = lm_score.write_table
    monkeypatch.setattr(lm_score, "write_table", lambda df, name: seen.append((name, write(df, name))) or seen[-1][1])
    # In texts of two words, the second must be a target too; its token is told apart by the first one only.
    rows = [(i, "a b" if i % 2 else "c d") for i in range(6000)]
    models = [learn(spark.createDataFrame(r, "doc_id long, text string").repartition(n)) for r, n in ((rows, 1), (rows[::-1], 3))]
    assert all((x == y).all() for x, y in zip(models[0][1].parts, models[1][1].parts, strict=True))
    trained = [t.agg({"n": "sum"}).first()[0] for name, t in seen if name == "models" and t.count() > 2]
    assert sum(trained[: len(trained) // 2]) % 12_000 == 0
    vocabulary, network = models[0]
    cls = vocabulary.look_up(K.word_hashes(np.frombuffer(b"a b c d", np.uint8), np.array([0, 7]))[0])[0]
    edge = TOKENS
    context = np.array([[edge] * 2, [cls[0], cls[2]], [edge] * 2, [edge] * 2])
    good, bad = network.log_probability(context, cls[[1, 3]]), network.log_probability(context, cls[[3, 1]])
    assert (good > bad + 1).all()


def test_words_beyond_top_have_their_own_shares(spark, monkeypatch):
    from framelake.llm import lm_score

    monkeypatch.setattr(lm_score, "TOP", 2)
    monkeypatch.setattr(lm_score, "HEAD", lm_score.HEAD)
    texts = ["the of " * 50 + "often " * 20 + "seldom", "the often", "the seldom", "", None]
    frame = spark.createDataFrame([(i % 3, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    model = learn(frame)
    n = Counter(w for t in texts for w in (t or "").split())
    hashed = {w: int(K.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0][0]) for w in n}
    want = []
    for i, t in enumerate(texts):
        words = (t or "").split()
        cls, _ = model[0].look_up(np.array([hashed[w] for w in words], np.uint64))
        each = model[1].log_probability(contexts(cls, np.array([0, len(cls)])), cls) if words else np.zeros(0)
        tail = {w: sum(n[x] for x in n if x not in ("the", "of") and hashed[x] % lm_score.TAIL == hashed[w] % lm_score.TAIL) for w in words}
        want.append((i % 3, len(words), round(float(sum(each) + sum(np.log(n[w] / tail[w]) for w in words if w not in ("the", "of"))), 2)))
    assert sorted((r["doc_id"], r["n_words"], round(r["log_prob"], 2)) for r in score(frame, model).collect()) == sorted(want)


def test_a_step_takes_the_softmax_of_all_classes_at_once(monkeypatch):
    calls, plain = [], lm_score._softmax
    monkeypatch.setattr(lm_score, "_softmax", lambda z: calls.append(z.shape) or plain(z))
    tokens = np.arange(2 * lm_score.BATCH) * 67 % lm_score.TOKENS
    network = lm_score.Network()
    before = network.log_probability(around := lm_score.contexts(tokens, np.array([0, len(tokens)])), tokens).mean()
    network.improve(around, tokens, [np.zeros_like(x) for x in network.parts])
    assert len(calls) == 4 and network.log_probability(around, tokens).mean() > before


def test_a_step_follows_the_gradients_of_the_formula_whatever_is_multiplied_at_once(monkeypatch):
    r = np.random.default_rng(3)
    tokens = np.minimum(r.zipf(1.2, lm_score.BATCH + 300) - 1, TOKENS - 1)
    around = contexts(tokens, np.array([0, 40, 40, len(tokens)]))
    trained = []
    for few in (0, 1, 8, 2000):
        monkeypatch.setattr(lm_score, "FEW", few)
        network = Network()
        network.improve(around, tokens, squares := [np.zeros_like(x) for x in network.parts])
        trained.append(network.flat())
        assert all((x >= 0).all() and x.any() for x in squares)
    assert all(np.abs(trained[0] - t).max() < 1e-3 for t in trained[1:])
    # One step by plain sums over the rows.
    network, n = Network(), 300
    e, w1, b1, w2, b2 = (x.astype(np.float64) for x in network.parts)
    want = [np.zeros_like(x) for x in (e, w1, b1, w2, b2)]
    soft = lambda z: np.exp(z) / np.exp(z).sum()
    for t, c in zip(tokens[:n], around[:, :n].T, strict=True):
        level, h = t // lm_score.SIZE, np.tanh(sum(e[k, c[k]] for k in range(4)))
        p, q = soft(h @ w1 + b1), soft(h @ w2[level] + b2[level])
        p[level] -= 1
        q[t % lm_score.SIZE] -= 1
        for part, at, g in ((1, ..., np.outer(h, p)), (2, ..., p), (3, level, np.outer(h, q)), (4, level, q)):
            want[part][at] += g / n
        for k in range(4):
            want[0][k, c[k]] += (w1 @ p + w2[level] @ q) * (1 - h * h) / n
    network.improve(around[:, :n], tokens[:n], squares := [np.zeros_like(x) for x in network.parts])
    for size, g in zip(squares, want, strict=True):
        assert np.allclose(np.sqrt(size), np.abs(g), atol=1e-6)


def test_words_are_found_and_counted_many_at_once(monkeypatch):
    r = np.random.default_rng(5)
    ids = np.unique(np.concatenate([r.integers(0, 2**64, 500, dtype=np.uint64), np.arange(2**50, 2**50 + 90, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)]))
    known = ids[::2]
    vocabulary = Vocabulary([(int(w), 3) for w in known.view(np.int64)], len(ids), 3 * len(ids))
    assert (vocabulary.known(ids) == np.isin(ids, known)).all() and (vocabulary.ids[vocabulary.place(known)[0]] == known).all()
    # Many short batches make one batch of counts.
    texts = [f"a b {i % 3} Word{i}" for i in range(300)]
    batches = [pa.record_batch({"text": pa.array(texts[i : i + 10])}) for i in range(0, 300, 10)]
    (got,) = lm_score._counts(iter(batches))
    assert sum(got.column("n").to_pylist()) == 1200 and got.num_rows == 305
    # Words are the same however the texts are blocked.
    data, offsets = K.text_bytes(pa.array([*texts, "", "  ", None, "x" * 900]))
    whole = K.word_hashes(data, offsets)
    blocks = K.blocks
    monkeypatch.setattr(K, "blocks", lambda offsets: blocks(offsets, 100))
    assert all((a == b).all() for a, b in zip(whole, K.word_hashes(data, offsets), strict=True))
