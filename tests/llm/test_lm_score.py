from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from conftest import MEDIUM
from odd_rows import DOCS, documents

from plumbline.llm import lm_score as lm
from plumbline.llm.bytestream import word_bounds


def test_gradient_is_that_of_the_loss():
    """A step lowers the loss as finite differences say."""
    rng = np.random.default_rng(1)
    net = lm.Network.new()
    net.cluster += rng.normal(0, 0.1, net.cluster.shape).astype(np.float32)
    net.within += rng.normal(0, 0.1, net.within.shape).astype(np.float32)
    around, word = rng.integers(0, 50, (4, 400)), rng.integers(0, 300, 400)
    before = net.log_probability(around, word).mean()
    for _ in range(5):
        net.step(around, word, 0.2)
    assert net.log_probability(around, word).mean() > before + 0.1


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    net = lm.Network.of(rng.normal(0, 0.2, len(lm.Network.new().flat())))
    around = np.repeat(rng.integers(0, lm.SIZE, (4, 1)), lm.SIZE, axis=1)
    assert abs(np.exp(net.log_probability(around, np.arange(lm.SIZE)).astype(float)).sum() - 1) < 1e-3


def test_contexts_stop_at_the_text():
    ids, begin = np.arange(7), np.array([0, 3, 3, 7])
    around = lm.contexts(ids, begin)
    assert around[:, 0].tolist() == [lm.SIZE, lm.SIZE, 1, 2]
    assert around[:, 2].tolist() == [0, 1, lm.SIZE, lm.SIZE]
    assert around[:, 3].tolist() == [lm.SIZE, lm.SIZE, 4, 5]


@pytest.fixture(scope="module")
def trained(spark):
    texts = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("text")
    words = lm.vocabulary(texts)
    return words, lm.train(texts, words)


def test_training_beats_the_untrained_and_shuffled_text(spark, trained):
    words, net = trained
    texts = [r.text for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").limit(200).collect()]
    rng = np.random.default_rng(4)

    def score(network, text):
        raw = np.frombuffer(text.encode(), np.uint8)
        hashes, begin = lm.word_hashes(raw, np.array([0, len(raw)]))
        ids = lm.Words(words).ids(hashes)
        return network.log_probability(lm.contexts(ids, begin), ids).astype(float).mean()

    own = np.mean([score(net, t) for t in texts])
    assert own > np.mean([score(lm.Network.new(), t) for t in texts]) + 1
    mixed = np.mean([score(net, " ".join(rng.permutation(t.split()))) for t in texts])
    assert own > mixed


def test_odd_rows_and_sums(spark, trained):
    docs = documents(spark)
    got = lm.scored(docs).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, *_ in DOCS)
    for r in got:
        text = dict((d, t) for d, t, *_ in DOCS)[r.doc_id]
        raw = np.frombuffer((text or "").encode(), np.uint8)
        assert r.n_tokens == len(word_bounds(raw, np.array([0, len(raw)]))[0])
        if r.n_tokens:
            assert abs(r.mean_log_probability * r.n_tokens - r.log_likelihood) < 1e-6 * abs(r.log_likelihood)
        else:
            assert r.log_likelihood == 0 and r.mean_log_probability is None
    assert lm.scored(docs.limit(0)).count() == 0


def test_scores_equal_the_network_word_by_word(spark, trained):
    words, net = trained
    texts = ["The und le", "el and of the x"]
    context = spark.sparkContext
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.log_likelihood for r in docs.mapInArrow(lm._scorer(context.broadcast(words), context.broadcast(net.flat())), lm.SCORES).collect()}
    for doc, text in enumerate(texts):
        raw = np.frombuffer(text.encode(), np.uint8)
        hashes, begin = lm.word_hashes(raw, np.array([0, len(raw)]))
        ids, total = lm.Words(words).ids(hashes), 0.0
        for i, word in enumerate(ids.tolist()):
            around = [ids[i + s] if 0 <= i + s < len(ids) else lm.SIZE for s in lm.AROUND]
            h = np.append(np.tanh(sum(net.embed[k][a] for k, a in enumerate(around))), 1.0)
            for z, at in ((h @ net.cluster, word // lm.WITHIN), (h @ net.within[word // lm.WITHIN], word % lm.WITHIN)):
                total += z[at] - np.log(np.exp(z).sum())
        assert abs(got[doc] - total) < 1e-3


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_rounds_train_on_every_token_once(spark, monkeypatch, rounds):
    """Over all rounds each token of each text is a target once, whatever its place."""
    texts = [" ".join(f"w{t}-{i}" for i in range(n)) for t, n in enumerate((1, 2, 23, 40))] + [None, " "]
    data, offsets = lm.flat(pa.array(texts))
    hashes, _ = lm.word_hashes(data, offsets)
    words, values, targets = SimpleNamespace(value=hashes), SimpleNamespace(value=lm.Network.new().flat()), []
    monkeypatch.setattr(lm.Network, "step", lambda self, around, word, rate: targets.extend(word.tolist()))
    monkeypatch.setattr(lm, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    for turn in range(rounds):
        list(lm._trainer(words, values, turn, rounds)([pa.RecordBatch.from_pydict({"text": texts})]))
    assert sorted(targets) == list(range(66))


def test_each_rare_word_has_its_own_probability(spark, monkeypatch):
    """With few words in the network, of two words in one bucket the more frequent is the likelier by their counts."""
    monkeypatch.setattr(lm, "frequent", lambda counts: np.zeros(0, np.uint64))
    many = [f"word{i}" for i in range(200)]
    hashes = lm.word_hashes(*lm.flat(pa.array(many)))[0]
    bucket = (hashes >> np.uint64(32)).astype(np.int64) % lm.RARE
    a, b = np.flatnonzero(bucket == np.bincount(bucket).argmax())[:2]
    docs = spark.createDataFrame([(0, many[a]), (1, many[b])] + [(2, many[a])] * 5 + [(3, " ".join(many))], "doc_id bigint, text string")
    got = {r.doc_id: r.log_likelihood for r in lm.scored(docs).collect()}
    assert abs(got[0] - got[1] - np.log(7 / 2)) < 1e-9
    assert lm.scored(docs).count() == docs.count()


def test_the_network_grows_with_the_corpus(monkeypatch, spark):
    """Every word above the limit is the network's, also beyond the least size."""
    assert lm.least_count(10**12) > lm.least_count(10**9) and 10**12 / lm.least_count(10**12) > 10**9 / lm.least_count(10**9)
    counts = spark.range(20000).selectExpr("id AS word", "IF(id < 9000, 50000L, 1L) AS n")
    words = lm.frequent(counts)
    assert sorted(words.tolist()) == list(range(9000))
    net = lm.Network.new(room=lm.room_for(len(words)))
    ids = lm.Words(words).ids(np.arange(20000, dtype=np.uint64))
    assert len(set(ids[:9000].tolist())) == 9000 and (ids[9000:] >= lm.Words(words).size - lm.RARE).all()
    again = lm.Network.of(net.flat())
    assert again.embed.shape == net.embed.shape and again.within.shape == net.within.shape and (again.flat() == net.flat()).all()
    around = lm.contexts(ids[:500], np.array([0, 500]), lm.Words(words).size)
    assert np.isfinite(net.log_probability(around, ids[:500])).all()


def test_all_clusters_share_one_softmax(monkeypatch):
    """A step takes the softmax of clusters and that of words within them, over all tokens at once."""
    sizes = []

    def counted(z, own=lm._softmax):
        sizes.append(z.shape)
        return own(z)

    monkeypatch.setattr(lm, "_softmax", counted)
    rng = np.random.default_rng(3)
    net = lm.Network.new()
    net.step(rng.integers(0, lm.SIZE, (4, 500)), rng.integers(0, lm.SIZE, 500), 0.2)
    assert sizes == [(500, lm.CLUSTERS), (500, lm.WITHIN)]


def test_most_unknown_words_are_not_searched_for(monkeypatch):
    rng = np.random.default_rng(4)
    top, other = (rng.integers(0, 2**64, n, np.uint64) for n in (300, 5000))
    words, sought = lm.Words(top), []

    def counted(a, v, *more, own=np.searchsorted):
        sought.append(len(v))
        return own(a, v, *more)

    monkeypatch.setattr(lm.np, "searchsorted", counted)
    ids = words.ids(np.concatenate([top, other]))
    assert sum(sought) < 400
    assert ids[:300].tolist() == list(range(300))
    assert ids[300:].tolist() == [words.size - lm.RARE + (x >> 32) % lm.RARE for x in other.tolist()]
    assert lm.Words(top[:0]).ids(other).min() >= lm.CLUSTERS * lm.WITHIN - lm.RARE


@pytest.mark.parametrize("width", [1, 2, 3, 64, 142])
def test_largest_of_rows(width):
    z = np.random.default_rng(width).normal(size=(50, width)).astype(np.float32)
    assert (lm._row_max(z) == z.max(axis=1, keepdims=True)).all()
    want = z - np.log(np.exp(z.astype(float)).sum(axis=1, keepdims=True))
    at = np.arange(50) % width
    assert np.allclose(lm._log_softmax_at(z.copy(), at), want[np.arange(50), at], atol=1e-5)
