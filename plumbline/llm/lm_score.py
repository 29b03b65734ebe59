"""Masked pseudo-likelihood of documents under a bidirectional window network.

The network predicts every token from the two tokens on either side: their embeddings, one
table per place, are added, squashed, and fed to a softmax of two levels (cluster, then word).
Vocabulary counts come from all documents.  Training is data-parallel: in each round every
task runs stochastic gradient descent in numpy over the documents of its partition, starting from
the same parameters, and the parameters are averaged, weighted by tokens, in two levels of shuffles.
The rounds share out the tokens: over all of them each token is predicted once.
A document's score is the sum of the log-probabilities of its tokens, each given its context.

The network's words are those above a count that grows slower than the corpus, so there are the more of
them the larger it is.  Words below it share a few buckets in the network, and each has its part
of its bucket's probability: its count over the bucket's, by a join with the counts of all words.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.bytestream import LOWER, Hashed, flat, mix, signed, slices, word_bounds
from plumbline.llm.frames import kept, named

CLUSTERS = 64
WITHIN = 64  # words of a cluster, at least
RARE = 64  # ids for words beyond the vocabulary, by hash
WIDTH = 16
AROUND = (-2, -1, 1, 2)
ROUNDS = 2
BATCH = 2048
RATE = 0.5
SEED = 20268
BLOCKS = 16
SPREAD = 16
SIZE = CLUSTERS * WITHIN
MARK_BITS = 18
SHARE = 200  # the network knows words seen tokens ** (2 / 3) / SHARE times


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, A-Z lower-cased, and where each text's words begin."""
    starts, ends = word_bounds(data, offsets)
    hashes = Hashed(data, LOWER).of(starts, ends) ^ mix((ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)


def _counter(batches):
    for batch in batches:
        data, offsets = flat(batch.column("text"))
        # In slices: hashing takes many times the memory of the bytes.
        parts = [word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])[0] for a, b in slices(offsets)]
        found, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(signed(found)), pa.array(counts.astype(np.int64))], names=["word", "n"])


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, n`` of all words of all texts, by hash."""
    return kept(texts.mapInArrow(_counter, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "lm-words")


def least_count(tokens: int) -> int:
    """How often a word has to occur among so many tokens for the network to know it."""
    return math.ceil(tokens ** (2 / 3) / SHARE)


def frequent(counts: DataFrame, size: int = SIZE - RARE) -> np.ndarray:
    """Hashes of the words above the limit, the ``size`` most frequent at least, most frequent first."""
    often = counts.where(F.col("n") >= least_count(counts.agg(F.sum("n")).first()[0] or 0))
    ranked = (F.desc("n"), "word")
    top = often.orderBy(*ranked).collect()
    if len(top) < size:
        top = counts.orderBy(*ranked).limit(size).collect()
    return np.array([r.word for r in top], np.int64).view(np.uint64)


def vocabulary(texts: DataFrame) -> np.ndarray:
    """Hashes of the words that the network knows, most frequent first."""
    return frequent(word_counts(texts))


def room_for(words: int) -> int:
    """Words a cluster has to hold for so many words and the rare ones."""
    return max(WITHIN, -(-(words + RARE) // CLUSTERS))


@dataclass
class Network:
    embed: np.ndarray  # place x (word + one for beyond the text) x width
    cluster: np.ndarray  # width + 1 x clusters; the last row is the bias
    within: np.ndarray  # cluster x width + 1 x words

    @classmethod
    def new(cls, seed: int = SEED, room: int = WITHIN) -> Network:
        rng = np.random.default_rng(seed)
        return cls(
            rng.normal(0, 0.1, (len(AROUND), CLUSTERS * room + 1, WIDTH)).astype(np.float32),
            np.zeros((WIDTH + 1, CLUSTERS), np.float32),
            np.zeros((CLUSTERS, WIDTH + 1, room), np.float32),
        )

    @property
    def room(self) -> int:
        return self.within.shape[2]

    def flat(self) -> np.ndarray:
        return np.concatenate([self.embed.ravel(), self.cluster.ravel(), self.within.ravel()])

    @classmethod
    def of(cls, values: np.ndarray) -> Network:
        fixed = (len(AROUND) * WIDTH, (WIDTH + 1) * CLUSTERS)
        room = (len(values) - sum(fixed)) // (CLUSTERS * (fixed[0] + WIDTH + 1))
        a = fixed[0] * (CLUSTERS * room + 1)
        b = a + fixed[1]
        values = values.astype(np.float32)
        return cls(
            values[:a].reshape(len(AROUND), CLUSTERS * room + 1, WIDTH).copy(),
            values[a:b].reshape(WIDTH + 1, CLUSTERS).copy(),
            values[b:].reshape(CLUSTERS, WIDTH + 1, room).copy(),
        )

    def hidden(self, around: np.ndarray) -> np.ndarray:
        """Context vectors with a one appended for the bias; ``around`` is place x token."""
        h = self.embed[0][around[0]]
        for k in range(1, len(AROUND)):
            h = h + self.embed[k][around[k]]
        return np.concatenate([np.tanh(h), np.ones((h.shape[0], 1), np.float32)], axis=1)

    def log_probability(self, around: np.ndarray, word: np.ndarray) -> np.ndarray:
        h = self.hidden(around)
        group, place = word // self.room, word % self.room
        out = _log_softmax_at(h @ self.cluster, group)
        order, edge, known = _by_cluster(group)
        out[order] += _log_softmax_at(self._within(h[order], edge, known), place[order])
        return out

    def _within(self, h: np.ndarray, edge: list[int], known: list[int]) -> np.ndarray:
        """What the words of its cluster get for each token; tokens are in the order of their clusters."""
        z = np.empty((len(h), self.room), np.float32)
        for c in known:
            np.matmul(h[edge[c] : edge[c + 1]], self.within[c], out=z[edge[c] : edge[c + 1]])
        return z

    def step(self, around: np.ndarray, word: np.ndarray, rate: float) -> None:
        """One step of stochastic gradient descent on a batch of tokens."""
        n = len(word)
        h = self.hidden(around)
        group, place = word // self.room, word % self.room
        error = _softmax(h @ self.cluster)
        error[np.arange(n), group] -= 1
        back = error @ self.cluster.T
        self.cluster -= rate * h.T @ error / n
        # Tokens of a cluster lie side by side, so that all clusters share the steps over whole arrays.
        order, edge, known = _by_cluster(group)
        h_of = h[order]
        error = _softmax(self._within(h_of, edge, known))
        error[np.arange(n), place[order]] -= 1
        pulled, risen = rate * h_of, np.zeros_like(self.within)
        own_back = np.empty_like(back)
        for c in known:
            some = slice(edge[c], edge[c + 1])
            np.matmul(error[some], self.within[c].T, out=own_back[some])
            np.matmul(pulled[some].T, error[some], out=risen[c])
        back[order] += own_back
        risen /= np.maximum(np.diff(edge), 1).astype(np.float32)[:, None, None]
        self.within -= risen
        pull = back[:, :-1] * (1 - h[:, :-1] ** 2)
        for k in range(len(AROUND)):
            order = _stable_order(around[k], self.embed.shape[1])
            own = around[k][order]
            head = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
            seen = np.diff(np.append(head, n))[:, None]
            # A word's embedding moves by the mean of its own pulls, however rare it is.
            self.embed[k][own[head]] -= rate * np.add.reduceat(pull[order], head, axis=0) / np.maximum(seen, 4)


def _stable_order(numbers: np.ndarray, below: int) -> np.ndarray:
    """Stable sorting order of numbers; those of 16 bits are sorted by their digits."""
    return np.argsort(numbers.astype(np.uint16) if below <= 1 << 16 else numbers, kind="stable")


def _by_cluster(group: np.ndarray) -> tuple[np.ndarray, list[int], list[int]]:
    """Tokens in the order of their clusters, where each cluster begins there, and which have tokens."""
    order = _stable_order(group, CLUSTERS)
    edge = np.searchsorted(group[order], np.arange(CLUSTERS + 1))
    return order, edge.tolist(), np.flatnonzero(np.diff(edge)).tolist()


def _row_max(z: np.ndarray) -> np.ndarray:
    """The largest of each row, as a column: halves are compared, which takes few steps over long arrays."""
    while z.shape[1] > 1:
        half = (z.shape[1] + 1) // 2
        z = np.maximum(z[:, :half], z[:, -half:])
    return z


def _softmax(z: np.ndarray) -> np.ndarray:
    """Softmax of each row, in the place of ``z``."""
    z -= _row_max(z)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def _log_softmax_at(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log-softmax of each row at one column; ``z`` is overwritten."""
    top = _row_max(z)
    # Of one column, the largest is the column itself.
    top, own = top[:, 0].copy(), z[np.arange(len(z)), at]
    z -= top[:, None]
    np.exp(z, out=z)
    return own - top - np.log(z.sum(axis=1))


class Words:
    """Ids of words: by frequency, rare words by hash."""

    def __init__(self, top: np.ndarray):
        self.order = np.argsort(top)
        self.sorted = top[self.order]
        self.size = CLUSTERS * room_for(len(top))
        self.marks = np.zeros(1 << MARK_BITS, bool)
        self.marks[top >> np.uint64(64 - MARK_BITS)] = True

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        ids = self.size - RARE + ((hashes >> np.uint64(32)) % np.uint64(RARE)).astype(np.int64)
        # Most rare words are none of the others by a table of leading bits, and are not searched for.
        likely = np.flatnonzero(self.marks[hashes >> np.uint64(64 - MARK_BITS)])
        if len(likely):
            sought = hashes[likely]
            place = np.minimum(np.searchsorted(self.sorted, sought), len(self.sorted) - 1)
            hit = self.sorted[place] == sought
            ids[likely[hit]] = self.order[place[hit]]
        return ids


def contexts(ids: np.ndarray, begin: np.ndarray, beyond: int = SIZE) -> np.ndarray:
    """Words around each word, place by place; beyond the text it is the word numbered ``beyond``."""
    n = len(ids)
    text = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    around = np.full((len(AROUND), n), beyond, np.int64)
    for k, shift in enumerate(AROUND):
        a, b = max(0, -shift), min(n, n - shift)
        if a < b:
            same = text[a:b] == text[a + shift : b + shift]
            around[k, a:b] = np.where(same, ids[a + shift : b + shift], beyond)
    return around


PART = "block int, task int, weight double, amounts binary"


def _trainer(words, network, turn: int, rounds: int):
    def train(batches):
        own, ids_of = Network.of(network.value), Words(words.value)
        start, seen = own.flat(), 0
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        rate = RATE * (1 - turn / (2 * rounds))

        def spend(least: int) -> None:
            nonlocal waiting, held, seen
            if not held:
                return
            around = np.concatenate([w[0] for w in waiting], axis=1)
            word = np.concatenate([w[1] for w in waiting])
            at = 0
            while len(word) - at >= least and at < len(word):
                own.step(around[:, at : at + BATCH], word[at : at + BATCH], rate)
                seen += len(word[at : at + BATCH])
                at += BATCH
            waiting, held = [(around[:, at:], word[at:])], max(len(word) - at, 0)

        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for first, last in slices(offsets):
                bounds = offsets[first : last + 1]
                hashes, begin = word_hashes(data[bounds[0] : bounds[-1]], bounds - bounds[0])
                ids = ids_of.ids(hashes)
                around = contexts(ids, begin, ids_of.size)
                place = np.arange(len(ids)) - np.repeat(begin[:-1], np.diff(begin))
                # Each round takes every so many-th token of a text, so that all rounds take each token once.
                some = np.flatnonzero(place % rounds == turn)
                # Neighbouring tokens of one text do not share a batch.
                some = some[np.argsort(mix(some.astype(np.uint64)), kind="stable")]
                waiting.append((around[:, some], ids[some]))
                held += len(some)
                spend(BATCH)
        spend(1)
        if seen:
            for block, values in enumerate(np.array_split((own.flat() - start).astype(np.float64), BLOCKS)):
                yield pa.RecordBatch.from_pydict(
                    {"block": [block], "task": [TaskContext.get().partitionId()], "weight": [float(seen)], "amounts": [(values * seen).astype(np.float32).tobytes()]},
                    schema=_PART,
                )

    return train


_PART = pa.schema([("block", pa.int32()), ("task", pa.int32()), ("weight", pa.float64()), ("amounts", pa.binary())])


def _adder(batches):
    """Sums per block, in the order of the rows, and in memory of one model."""
    sums: dict[int, list] = {}
    task = 0
    for batch in batches:
        for block, task, weight, amounts in zip(*(batch.column(n) for n in ("block", "task", "weight", "amounts"))):
            values, weight = np.frombuffer(amounts.as_buffer(), np.float32).astype(np.float64), weight.as_py()
            if (held := sums.get(block.as_py())) is None:
                sums[block.as_py()] = [weight, values, task.as_py()]
            else:
                held[0] += weight
                held[1] += values
    for block, (weight, values, task) in sums.items():
        yield pa.RecordBatch.from_pydict({"block": [block], "task": [task], "weight": [weight], "amounts": [values.astype(np.float32).tobytes()]}, schema=_PART)


def _added(parts: DataFrame, *by) -> DataFrame:
    return parts.repartition(*by).sortWithinPartitions("block", "task").mapInArrow(_adder, PART)


def train(texts: DataFrame, words: np.ndarray, rounds: int = ROUNDS) -> Network:
    """A network trained over all of ``texts``; only one model's size reaches the driver."""
    context = texts.sparkSession.sparkContext
    shipped = context.broadcast(words)
    values = Network.new(room=room_for(len(words))).flat()
    for turn in range(rounds):
        parts = texts.mapInArrow(_trainer(shipped, context.broadcast(values), turn, rounds), PART)
        few = _added(parts, "block", F.col("task") % SPREAD)
        rows = _added(few, "block").collect()
        moved = np.zeros(len(values))
        for block, part in enumerate(np.array_split(np.arange(len(values)), BLOCKS)):
            for r in sorted((r for r in rows if r.block == block), key=lambda r: r.task):
                moved[part] += np.frombuffer(r.amounts, np.float32).astype(np.float64) / r.weight
        values = (values + moved).astype(np.float32)
    return Network.of(values)


SCORES = "row bigint, word bigint, doc_id bigint, n_tokens bigint, log_likelihood double"
_SCORES = pa.schema([("row", pa.int64()), ("word", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("log_likelihood", pa.float64())])


def _scorer(words, network):
    """A row per text with what the network says, and one per rare word with its hash and its text's row.

    The text's own row has a number spread over all hashes for its word, and is told by ``n_tokens``.
    """

    def score(batches):
        own, ids_of = Network.of(network.value), Words(words.value)
        task, done = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            docs = batch.column("doc_id")
            for first, last in slices(offsets, 1 << 19):
                bounds = offsets[first : last + 1]
                hashes, begin = word_hashes(data[bounds[0] : bounds[-1]], bounds - bounds[0])
                ids = ids_of.ids(hashes)
                around = contexts(ids, begin, ids_of.size)
                logs = np.zeros(len(ids) + 1)
                for a in range(0, len(ids), 1 << 14):
                    logs[a + 1 : a + 1 + len(ids[a : a + (1 << 14)])] = own.log_probability(around[:, a : a + (1 << 14)], ids[a : a + (1 << 14)])
                upto = np.cumsum(logs)
                size, row = np.diff(begin), task + done + np.arange(last - first)
                done += last - first
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(signed(mix(row.astype(np.uint64)))), docs.slice(first, last - first), pa.array(size.astype(np.int64)), pa.array(np.diff(upto[begin]))], schema=_SCORES)
                rare = ids >= ids_of.size - RARE
                none = pa.nulls(int(rare.sum()))
                if len(none):
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(row, size)[rare]), pa.array(signed(hashes[rare])), none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.float64())], schema=_SCORES)

    return score


def _bucket(word: Column) -> Column:
    """Which bucket a rare word is in, as in ``Words``."""
    return (F.shiftrightunsigned(word, 32) % RARE).cast("int")


def _with_shares(parts: DataFrame, counts: DataFrame, words: np.ndarray) -> DataFrame:
    """Scores of texts, with the part that each rare word has in its bucket."""
    top = parts.sparkSession.createDataFrame(pa.table({"word": pa.array(signed(words))}))
    rare = kept(counts.join(F.broadcast(top), "word", "left_anti"), "lm-rare")
    logs = [0.0] * RARE
    for bucket, n in rare.groupBy(_bucket(F.col("word"))).agg(F.sum("n")).collect():
        logs[bucket] = math.log(n)
    share = F.log("n") - F.element_at(F.array(*map(F.lit, logs)), _bucket(F.col("word")) + 1)
    own = F.col("n_tokens").isNotNull()
    summed = (
        parts.join(rare.hint("shuffle_hash"), "word", "left")
        .groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("n_tokens").alias("n_tokens"),
            F.sum(F.when(own, F.col("log_likelihood")).otherwise(share)).alias("log_likelihood"),
        )
    )
    return summed.select("doc_id", "n_tokens", "log_likelihood", F.expr("CASE WHEN n_tokens > 0 THEN log_likelihood / n_tokens END AS mean_log_probability"))


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Per row ``doc_id, n_tokens, log_likelihood, mean_log_probability`` under a network trained on ``docs``.

    Texts without words, null texts among them, have no token, log-likelihood 0 and a null mean.
    Each row is scored by its text alone: repeated ids and null ids do no harm.
    Other columns are not looked at; an empty table gives no rows.
    """
    texts = docs.select(named(id_col).cast("bigint").alias("doc_id"), named(text_col).alias("text"))
    counts = word_counts(texts.select("text"))
    words = frequent(counts)
    network = train(texts.select("text"), words, rounds)
    context = docs.sparkSession.sparkContext
    parts = texts.mapInArrow(_scorer(context.broadcast(words), context.broadcast(network.flat())), SCORES)
    return _with_shares(parts, counts, words)
