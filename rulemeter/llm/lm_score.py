"""Language-model scores by masked pseudo-likelihood.

Counts of all words of the corpus are a distributed table. A window network, trained in numpy, predicts every token from
WIDTH tokens on either side, never from itself: the neighbours' vectors go through a matrix for each distance and are added
up; one softmax tells the word's class, a second one, of the class's own weights, the word in it. The VOCABULARY most
frequent words are dealt to CLASSES classes; every other word stands in one of GROUPS groups by its ending, of which it has
the share that its count in the whole corpus gives. So the conditional probabilities of all words add up to one.

Training is data-parallel over all documents. A document's hash names its trainer, the number of trainers follows from the
number of tokens; each makes one pass over its documents in the order of their hashes, and every row of the parameters is
averaged by how often a trainer used it. This is done ROUNDS times. Scores thus don't depend on the partitions of the
input. A document's score is the sum of its tokens' conditional log-probabilities."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, fresh_path, materialize

#: Words with weights of their own, words whose counts every task holds, classes of the former, groups of all others.
VOCABULARY, KNOWN, CLASSES, GROUPS = 2048, 65_536, 32, 16
WIDTH, DIM, ROUNDS, RATE, BATCH, SEED = 2, 12, 2, 0.5, 8192, 11
#: Tokens for each trainer, and most trainers; a trainer's parameters are 0.2 MB.
TRAINER_TOKENS, MAX_TRAINERS = 4_000_000, 1024
#: Rows of parameters that travel together, and distinct words that a task counts before it hands them on.
SLICE, HELD = 512, 200_000


def _words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


def _group(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % GROUPS


def word_counts(docs: DataFrame) -> DataFrame:
    """(hash, word, grp, n) of every lower-cased word of all texts; partial sums are taken before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> pa.RecordBatch:
            words = list(held)
            return pa.record_batch([pa.array([_hash(w) for w in words], pa.int64()), pa.array(words, pa.binary()), pa.array([held[w] for w in words], pa.int64())], names=["hash", "word", "n"])

        held: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                held.update(_words(t))
            if len(held) > HELD:
                yield told()
                held = Counter()
        yield told()

    rows = docs.select("text").mapInArrow(run, "hash long, word binary, n long")
    return rows.groupBy("hash").agg(F.min("word").alias("word"), F.sum("n").alias("n")).select("hash", "word", (F.crc32(F.substring("word", -2, 2)) % GROUPS).cast("int").alias("grp"), "n")


class Words:
    """What every task knows of the words: (word, count) of the most frequent ones, and each group's count and types."""

    def __init__(self, known: list[tuple[bytes, int]], mass: list[int], types: list[int], vocabulary: int = VOCABULARY) -> None:
        self.known, self.mass, self.types, self.size = known, mass, types, min(vocabulary, len(known))
        self._index: tuple[dict[bytes, int], np.ndarray, np.ndarray] | None = None

    def __getstate__(self):
        return {**self.__dict__, "_index": None}

    def share(self, group: int, n: int) -> float:
        """Log share of its group of a word that occurs n times; 0 for any word never seen."""
        return float(np.log((n + 1) / (self.mass[group] + self.types[group] + 1)))

    def index(self) -> tuple[dict[bytes, int], np.ndarray, np.ndarray]:
        """Place of each known word, and by place its id and log share; ids 1.. are the vocabulary, then come the groups, 0 pads the ends."""
        if self._index is None:
            rare = [(_group(w), n) for w, n in self.known[self.size :]]
            ids = [*range(1, 1 + self.size), *(1 + self.size + g for g, _ in rare)]
            shares = [0.0] * self.size + [self.share(g, n) for g, n in rare]
            self._index = {w: i for i, (w, _) in enumerate(self.known)}, np.array(ids, np.uint16), np.array(shares, np.float64)
        return self._index

    def read(self, text: str | None) -> tuple[np.ndarray, float, Counter]:
        """Ids of a text's tokens, the log shares of its known words, and its other words' counts."""
        (index, ids, shares), words = self.index(), _words(text)
        at = np.fromiter(map(index.get, words, repeat(-1)), np.int32, len(words))
        other = np.flatnonzero(at < 0)
        rare = [words[i] for i in other.tolist()]
        if not rare:
            return ids[at], float(shares[at].sum()), Counter()
        out, counts = np.empty(len(at), np.uint16), Counter(rare)
        known = at[at >= 0]
        out[at >= 0] = ids[known]
        group = {w: 1 + self.size + _group(w) for w in counts}
        out[other] = [group[w] for w in rare]
        return out, float(shares[known].sum()), counts


class Network:
    """Parameters and passes of the window network over ids 0 (pad), 1..size (vocabulary), then GROUPS groups."""

    def __init__(self, size: int, classes: int = CLASSES, width: int = WIDTH, dim: int = DIM) -> None:
        self.size, self.width, self.dim = size, width, dim
        self.per = max(1, -(-size // classes))
        self.classes = -(-size // self.per)
        self.n = 1 + size + GROUPS
        rng = np.random.default_rng(SEED)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        self.e = draw(self.n, dim)
        self.m = np.tile(np.eye(dim, dtype=np.float32), (2 * width, 1, 1)) + draw(2 * width, dim, dim)
        self.u = np.concatenate((draw(self.classes + GROUPS, dim), np.zeros((self.classes + GROUPS, 1), np.float32)), axis=1)
        self.w = np.concatenate((draw(self.classes * self.per, dim), np.zeros((self.classes * self.per, 1), np.float32)), axis=1)
        self.w[size:, dim] = -1e9  # places of the last class that no word has
        self.used = np.zeros(self.n + self.classes * self.per, np.float64)

    def start(self, words: Words) -> None:
        """Biases that give every word its share of the corpus before any training."""
        counts = np.array([n for _, n in words.known[: self.size]], np.float64)
        self.w[: self.size, -1] = np.log(counts)
        mass = np.concatenate(([counts[c * self.per : (c + 1) * self.per].sum() for c in range(self.classes)], words.mass))
        self.u[:, -1] = np.log((mass + 1) / (mass + 1).sum())

    def rows(self) -> np.ndarray:
        """All parameters, one row each of DIM weights and a bias."""
        wide = lambda x: np.concatenate((x, np.zeros((len(x), 1), np.float32)), axis=1)
        return np.concatenate((wide(self.e), self.w, self.u, wide(self.m.reshape(-1, self.dim))))

    def load(self, rows: np.ndarray) -> None:
        rows = rows.astype(np.float32)
        a, b, c = self.n, self.n + len(self.w), self.n + len(self.w) + len(self.u)
        self.e, self.w, self.u, self.m = rows[:a, :-1].copy(), rows[a:b].copy(), rows[b:c].copy(), rows[c:, :-1].reshape(self.m.shape).copy()

    def weights(self, seen: int) -> np.ndarray:
        """How often each row was used."""
        return np.concatenate((self.used, np.full(len(self.u) + 2 * self.width * self.dim, float(seen))))

    def stream(self, texts: list[np.ndarray]) -> np.ndarray:
        pad = np.zeros(self.width, np.int64)
        return np.concatenate([pad, *(x for t in texts for x in (t.astype(np.int64), pad))])

    def _hidden(self, ids: np.ndarray) -> np.ndarray:
        """The hidden layer of the ids that have WIDTH ids on either side, a row each."""
        v, k, n = self.e[ids], self.width, len(ids) - 2 * self.width
        a = np.zeros((n, self.dim), np.float32)
        for d, m in zip((*range(-k, 0), *range(1, k + 1)), self.m, strict=True):
            a += v[k + d : k + d + n] @ m
        return np.tanh(a)

    def _class_of(self, centre: np.ndarray) -> np.ndarray:
        return np.where(centre <= self.size, (centre - 1) // self.per, centre - 1 - self.size + self.classes)

    @staticmethod
    def _soft(z: np.ndarray) -> np.ndarray:
        """Log of the softmax of each row."""
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def _by_class(self, centre: np.ndarray, cls: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """(rows of w, places of the tokens of that class, which of the class's words each is)."""
        order = np.argsort(cls, kind="stable")
        ends = np.searchsorted(cls[order], np.arange(self.classes + 1))
        for c in range(self.classes):
            at = order[ends[c] : ends[c + 1]]
            if len(at):
                yield slice(c * self.per, (c + 1) * self.per), at, (centre[at] - 1) % self.per

    def log_prob(self, ids: np.ndarray) -> np.ndarray:
        """Log-probability of every token of a stream given its neighbours (of pads: 0); groups without a word's share."""
        k, out = self.width, np.zeros(len(ids))
        for s in range(k, len(ids) - k, BATCH * 4):
            part = ids[s - k : min(s + BATCH * 4, len(ids) - k) + k]
            centre = part[k : len(part) - k]
            h = self._hidden(part)
            real = np.flatnonzero(centre)
            centre, h = centre[real], h[real]
            cls = self._class_of(centre)
            got = self._soft(h @ self.u[:, :-1].T + self.u[:, -1])[np.arange(len(h)), cls].astype(np.float64)
            for rows, at, which in self._by_class(centre, cls):
                got[at] += self._soft(h[at] @ self.w[rows, :-1].T + self.w[rows, -1])[np.arange(len(at)), which]
            out[s + real] = got
        return out

    def _columns(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the ids that have WIDTH ids on either side: their neighbours' vectors, and the hidden layer, of each a column that ends in 1."""
        v, k, n, dim = self.e[ids], self.width, len(ids) - 2 * self.width, self.dim
        near = np.empty((n, 2 * k * dim), np.float32)
        for i, d in enumerate((*range(-k, 0), *range(1, k + 1))):
            near[:, i * dim : (i + 1) * dim] = v[k + d : k + d + n]
        h = np.ones((dim + 1, n), np.float32)
        np.tanh(self.m.reshape(-1, dim).T @ near.T, out=h[:-1])
        return near, h

    @staticmethod
    def _share(z: np.ndarray) -> np.ndarray:
        """The softmax of each column, in place of z."""
        z -= z.max(axis=0)
        np.exp(z, out=z)
        z /= z.sum(axis=0)
        return z

    def _dealt(self, centre: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, list[tuple[slice, slice, np.ndarray]]]:
        """Places of the tokens by class; (rows of w, which of these places, which of the class's words each is)."""
        order = np.argsort(cls.astype(np.uint16), kind="stable")
        ends = np.searchsorted(cls[order], np.arange(self.classes + 1))
        order = order[: ends[-1]]
        which = (centre[order] - 1) % self.per
        return order, [(slice(c * self.per, (c + 1) * self.per), slice(a, b), which[a:b]) for c, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if b > a]

    def step(self, ids: np.ndarray, rate: float = RATE) -> int:
        """One step on a piece of a stream; its first and last WIDTH ids are context only. How many tokens it predicted."""
        k, dim = self.width, self.dim
        near, full = self._columns(ids)
        real = np.flatnonzero(ids[k : len(ids) - k])
        centre, h = ids[k : len(ids) - k][real], full[:, real]
        n = len(centre)
        if not n:
            return 0
        cls = self._class_of(centre)
        p = self._share(self.u @ h)
        p[cls, np.arange(n)] -= 1
        g = self.u.T @ p
        self.u -= rate / n * (p @ h.T)
        order, parts = self._dealt(centre, cls)
        x = h[:, order]
        more = np.empty_like(x)
        for rows, at, which in parts:
            m = len(which)
            q = self._share(self.w[rows] @ x[:, at])
            q[which, np.arange(m)] -= 1
            more[:, at] = self.w[rows].T @ q
            self.w[rows] -= rate / m * (q @ x[:, at].T)
            self.used[self.n + rows.start : self.n + rows.stop] += m
        g[:, order] += more
        a = np.zeros((dim, full.shape[1]), np.float32)
        a[:, real] = (g * (1 - h * h))[:-1]
        m = self.m.reshape(-1, dim)
        to, back = a.T @ m.T, np.zeros((len(ids), dim), np.float32)
        for i, d in enumerate((*range(-k, 0), *range(1, k + 1))):
            back[k + d : k + d + len(to)] += to[:, i * dim : (i + 1) * dim]
        self.m = self.m - (rate / n * (near.T @ a.T)).reshape(self.m.shape)
        # a word's row moves by the mean of its own gradients in the batch
        order = np.argsort(ids.astype(np.uint16), kind="stable")
        words = ids[order]
        first = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1])))
        words, times = words[first], np.diff(np.append(first, len(ids)))
        self.e[words] -= rate * np.add.reduceat(back[order], first, axis=0) / times[:, None]
        self.used[words] += times
        return n


class _Trainer:
    """Steps over documents one after another, in minibatches that depend on nothing else."""

    def __init__(self, net: Network) -> None:
        self.net, self.texts, self.held, self.seen = net, [], 0, 0

    def add(self, ids: np.ndarray) -> None:
        self.texts.append(ids)
        self.held += len(ids)
        if self.held >= BATCH:
            self.flush()

    def flush(self) -> None:
        ids, k = self.net.stream(self.texts), self.net.width
        for s in range(k, len(ids) - k, BATCH):
            self.seen += self.net.step(ids[s - k : min(s + BATCH, len(ids) - k) + k])
        self.texts, self.held = [], 0


def _averaged(told: DataFrame, start: np.ndarray) -> np.ndarray:
    """Parameters from trainers' slices (slice, trainer, weights, rows), each row averaged by its weights in the order of the
    trainers; a row that none used stays. A task holds one slice at a time."""
    n = int(told.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total, weight = None, None, None

        def out() -> pa.RecordBatch:
            rows = np.where(weight[:, None] > 0, total / np.maximum(weight, 1e-300)[:, None], np.nan)
            return pa.record_batch([pa.array([at], pa.int32()), pa.array([rows.tobytes()], pa.binary())], names=["slice", "rows"])

        for b in batches:
            for s, _, ws, rs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if s != at:
                    if at is not None:
                        yield out()
                    at, total, weight = s, 0.0, 0.0
                w = np.frombuffer(ws, np.float64)
                total = total + w[:, None] * np.frombuffer(rs, np.float32).reshape(len(w), -1)
                weight = weight + w
        if at is not None:
            yield out()

    rows = start.astype(np.float64)
    met = told.repartition(n, "slice").sortWithinPartitions("slice", "trainer").mapInArrow(run, "slice int, rows binary")
    for r in met.collect():  # one network
        part = np.frombuffer(r.rows, np.float64).reshape(-1, rows.shape[1])
        at = slice(r.slice * SLICE, r.slice * SLICE + len(part))
        rows[at] = np.where(np.isnan(part), rows[at], part)
    return rows.astype(np.float32)


def train(tokens: DataFrame, words: Words, trainers: int, rounds: int = ROUNDS) -> np.ndarray:
    """Parameters after ``rounds`` passes over all rows (trainer, place, ids), each trainer's in the order of ``place``."""
    bound_batches(tokens.sparkSession)
    size, first = words.size, Network(words.size)
    first.start(words)
    params = first.rows()
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], start=params) -> Iterator[pa.RecordBatch]:
            def told() -> pa.RecordBatch:
                work.flush()
                rows, weights = work.net.rows(), work.net.weights(work.seen)
                cuts = range(0, len(rows), SLICE)
                return pa.record_batch(
                    [pa.array(list(range(len(cuts))), pa.int32()), pa.array([at] * len(cuts), pa.int32()), pa.array([weights[c : c + SLICE].tobytes() for c in cuts], pa.binary()), pa.array([rows[c : c + SLICE].tobytes() for c in cuts], pa.binary())],
                    names=["slice", "trainer", "weights", "rows"],
                )

            at, work = None, None
            for b in batches:
                for t, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if t != at:
                        if at is not None:
                            yield told()
                        net = Network(size)
                        net.load(start)
                        at, work = t, _Trainer(net)
                    work.add(np.frombuffer(ids, np.uint16))
            if at is not None:
                yield told()

        dealt = tokens.filter("n_tokens > 0").repartitionById(trainers, F.col("trainer")).sortWithinPartitions("trainer", "place").select("trainer", "ids")
        params = _averaged(dealt.mapInArrow(run, "slice int, trainer int, weights binary, rows binary"), params)
    return params


def words_of(counts: DataFrame, vocabulary: int = VOCABULARY, known: int = KNOWN) -> Words:
    """The most frequent words (ties by spelling); what reaches the driver is bounded by ``known`` and GROUPS."""
    top = [(bytes(r.word), r.n) for r in counts.orderBy(F.desc("n"), "word").limit(known).select("word", "n").collect()]
    mass, types = [0] * GROUPS, [0] * GROUPS
    for r in counts.groupBy("grp").agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect():
        mass[r.grp], types[r.grp] = r.n, r.k
    for w, n in top[:vocabulary]:
        mass[_group(w)] -= n
        types[_group(w)] -= 1
    return Words(top, mass, types, vocabulary)


def _tokens(docs: DataFrame, words: Words, trainers: int) -> DataFrame:
    """(row, doc_id, trainer, place, n_tokens, ids, own, rare) of every document, written to the shared folder."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared, at = spark.sparkContext.broadcast(words), fresh_path(spark, "lm_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        know = shared.value
        for b in batches:
            read = [know.read(t) for t in b.column(3).to_pylist()]
            words = [(_hash(w), _group(w), n) for _, _, r in read for w, n in r.items()]
            kinds = {"hash": pa.int64(), "grp": pa.int32(), "times": pa.int32()}
            cells = pa.StructArray.from_arrays([pa.array([w[i] for w in words], t) for i, t in enumerate(kinds.values())], names=list(kinds))
            rare = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(r) for _, _, r in read)]), pa.int32()), cells)
            yield pa.record_batch(
                [b.column(0), b.column(1), b.column(2), pa.array([len(i) for i, _, _ in read], pa.int64()), pa.array([i.tobytes() for i, _, _ in read], pa.binary()), pa.array([o for _, o, _ in read], pa.float64()), rare],
                names=["row", "doc_id", "place", "n_tokens", "ids", "own", "rare"],
            )

    text = F.coalesce("text", F.lit(""))
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", text).alias("place"), text.alias("text"))
    told = numbered.mapInArrow(run, "row long, doc_id long, place long, n_tokens long, ids binary, own double, rare array<struct<hash:long,grp:int,times:int>>")
    told.withColumn("trainer", F.pmod("place", F.lit(trainers)).cast("int")).write.parquet(at)
    return spark.read.parquet(at)


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_tokens, log_prob, per_token) of every row of ``docs`` (doc_id, text).

    log_prob is the sum of the conditional log-probabilities of all tokens of the whole text, however long, per_token its
    mean. A null or empty text has no tokens, log_prob 0 and per_token null. Repeated rows get equal scores, an empty table
    gives no rows, a null doc_id stays null. Other columns are not read. The table of counts and the rare words' part of the
    sums grow with the corpus and are never gathered."""
    spark = docs.sparkSession
    bound_batches(spark)
    counts = materialize(word_counts(docs))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    words = words_of(counts)
    trainers = max(1, min(MAX_TRAINERS, total // TRAINER_TOKENS))
    tokens = _tokens(docs, words, trainers)
    params = train(tokens, words, trainers, rounds)
    shared = spark.sparkContext.broadcast((words.size, params))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rows = shared.value
        net = Network(size)
        net.load(rows)
        for b in batches:
            texts = [np.frombuffer(t, np.uint16) for t in b.column(3).to_pylist()]
            ends = np.cumsum([len(t) + net.width for t in texts])
            told = np.add.reduceat(net.log_prob(net.stream(texts))[net.width :], np.concatenate(([0], ends[:-1]))) if texts else np.empty(0)
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(told + b.column(4).to_numpy(), pa.float64())], names=["row", "doc_id", "n_tokens", "told"])

    told = tokens.select("row", "doc_id", "n_tokens", "ids", "own").mapInArrow(run, "row long, doc_id long, n_tokens long, told double")
    rest = [F.array(*(F.lit(m + t + 1) for m, t in zip(words.mass, words.types, strict=True)))]
    rare = tokens.select("row", F.explode("rare").alias("r")).select("row", "r.*").join(counts.select("hash", "n"), "hash")
    share = F.col("times") * F.log((F.col("n") + 1) / F.element_at(rest[0], F.col("grp") + 1))
    # added in steps of a fixed size, so that the order doesn't matter
    sums = rare.groupBy("row").agg((F.sum(F.round(share * 1e6).cast("long")) / 1e6).alias("rare"))
    log_prob = F.col("told") + F.coalesce("rare", F.lit(0.0))
    return told.join(sums.hint("merge"), "row", "left").select("doc_id", "n_tokens", log_prob.alias("log_prob"), F.when(F.col("n_tokens") > 0, log_prob / F.col("n_tokens")).alias("per_token"))
