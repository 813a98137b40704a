"""Language-model scores from a log-bilinear neural model.

Counts. Words of the training texts are counted exactly: partial counters in
each task, then one grouped sum. The most frequent words, at most ``HEAD`` of at
most ``WORD_BYTES`` bytes, are a bounded broadcast; the rest, none of which is
frequent, meet the texts that hold them in a shuffled join.

Model. The ``CLASSES`` outcomes are the end of a text, the most frequent words,
and ``BUCKETS`` classes that share out all other words by their last two bytes.
With context embeddings ``T1``, ``T2`` for the last and the one before and
outcome embeddings ``R``, the score of outcome k is ``(T1[a] + T2[b]) . R[k] +
bias[k]``. A hash deals the training rows to rounds, and within a round to
replicas, as many as the corpus has tokens for; a replica trains a copy of the
last round's model in numpy with noise-contrastive estimation over all its
tokens in the order of their hashes (noise: the unigram distribution, shared by
a batch), and copies are averaged by token counts, block by block, in Spark. So
the model depends on the rows alone, not on how tasks read them.

Texts are read twice, to count their words and to turn them into outcomes (two
bytes a token, in a scratch table); training and scoring read the outcomes.

Normalising. ``exp`` splits over the two contexts, so the normaliser of every
pair of contexts is one matrix product; token log-probabilities are then exact
table look-ups. A word of a shared class multiplies in (c + 0.5) / (N + 0.5 *
(V + 1)) of its class, unknown words included, so probabilities sum to one.

Nulls: a null text is empty (one token, the end); a null id falls into the
training fold of empty text. Without training texts every token scores by an
untrained model. Repeated rows score alike; an empty table gives an empty
result; columns other than id and text are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from dataclasses import dataclass, replace
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fold_of, lean, small_batches, table

HEAD, WORD_BYTES = 1 << 18, 128
CLASSES, BUCKETS, WIDTH = 2048, 256, 32
BATCH, NOISE, STEP = 1024, 128, 0.05
#: Texts turned into outcomes at a time.
TEXTS = 256
#: Words a task counts before it passes them on.
PENDING = 200_000
#: Rounds of training, each on its own part of the rows; tokens of a round that one replica trains on; replicas of a round at most.
ROUNDS, REPLICA_TOKENS, REPLICAS = 4, 1 << 21, 4096
#: Tokens of a text that are dealt to a replica together.
CHUNK = 1 << 14
#: Floats of the model in one block of the averaging.
SLICE = 1 << 14
END = b""


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()  # bytes: A-Z only, ASCII white space only


def bucket(word: bytes) -> int:
    return CLASSES - BUCKETS + zlib.crc32(word[-2:]) % BUCKETS


class Buckets(dict):
    """The class of two last bytes, of which there are 2**16 at most, and of fewer."""

    def __missing__(self, last: bytes) -> int:
        value = self[last] = bucket(last)
        return value


BUCKET_OF = Buckets()


def _counted(batches):
    seen: Counter = Counter()

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
        seen.clear()
        return out

    for batch in batches:
        for text in batch.column(0).cast(pa.binary()):
            words = tokens(text.as_py() or b"")
            words.append(END)
            seen.update(words)
            if len(seen) > PENDING:
                yield flush()
    yield flush()


@dataclass
class Vocabulary:
    """What every task needs of the counts; ``words`` are the head."""

    words: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int
    own: int
    class_total: np.ndarray
    class_distinct: np.ndarray

    def tables(self):
        place = {w: i for i, w in enumerate(self.words)}
        kind = np.array([self.kind(i, w) for i, w in enumerate(self.words)], np.int32)
        return place, kind

    def kind(self, i: int, word: bytes) -> int:
        return 0 if word == END else i + 1 if i < self.own else bucket(word)

    @property
    def within(self) -> np.ndarray:
        """log10 of each class's denominator; 0 where a class is one word."""
        shared = np.log10(np.maximum(self.class_total + 0.5 * (self.class_distinct + 1), 0.5))
        shared[: CLASSES - BUCKETS] = 0.0
        return shared


@dataclass
class Parameters:
    t1: np.ndarray
    t2: np.ndarray
    r: np.ndarray
    bias: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([self.t1.ravel(), self.t2.ravel(), self.r.ravel(), self.bias])

    @staticmethod
    def of(flat: np.ndarray) -> Parameters:
        n = CLASSES * WIDTH
        return Parameters(flat[:n].reshape(CLASSES, WIDTH), flat[n : 2 * n].reshape(CLASSES, WIDTH), flat[2 * n : 3 * n].reshape(CLASSES, WIDTH), flat[3 * n :])


def noise_of(v: Vocabulary) -> np.ndarray:
    weight = v.class_total + 0.5
    return weight / weight.sum()


def start(v: Vocabulary) -> Parameters:
    rng = np.random.default_rng(0)
    make = lambda: rng.normal(0, 0.1, (CLASSES, WIDTH)).astype(np.float32)
    return Parameters(make(), make(), make(), np.log(noise_of(v)).astype(np.float32))


def _grouped(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts the rows, the rows that occur, and where each begins in that order."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")  # outcomes fit two bytes, which numpy sorts by radix
    ordered = rows[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return order, ordered[first], first


def _rows_added(to: np.ndarray, grouped: tuple[np.ndarray, np.ndarray, np.ndarray], g: np.ndarray, squares: np.ndarray) -> None:
    """An AdaGrad step on the rows named, each with its summed gradient."""
    order, at, first = grouped
    wide = g.ndim > 1
    g = g.take(order, axis=0)
    # two neighbouring floats add as one complex number, in half the calls
    total = np.add.reduceat(g.view(np.complex64), first, axis=0).view(np.float32) if wide else np.add.reduceat(g, first)
    sums = squares.take(at) + (np.einsum("ij,ij->i", total, total) / WIDTH if wide else np.square(total))
    squares[at] = sums
    scale = STEP / np.sqrt(sums + 1e-6)
    total *= scale[:, None] if wide else scale
    total += to.take(at, axis=0)
    to[at] = total


class Trainer:
    """A copy of the model in training; its state is the parameters and AdaGrad's sums."""

    def __init__(self, p: Parameters, noise: np.ndarray, seed: int, squares: np.ndarray | None = None):
        self.p, self.noise, self.rng = Parameters.of(p.flat().copy()), noise, np.random.default_rng(seed)
        self.cumulative = np.cumsum(noise)
        self.log_expected = np.log(NOISE * noise).astype(np.float32)
        self.squares = np.full((4, CLASSES), 1e-2, np.float32) if squares is None else squares.reshape(4, CLASSES).copy()
        self.seen = 0
        self.loss = np.empty((BATCH, NOISE), np.float32)  # the largest array of a step, whose memory is kept

    def state(self) -> np.ndarray:
        return np.concatenate([self.p.flat(), self.squares.ravel()]).astype(np.float32)

    @staticmethod
    def resumed(state: np.ndarray, noise: np.ndarray, seed: int) -> Trainer:
        n = len(state) - 4 * CLASSES
        return Trainer(Parameters.of(state[:n]), noise, seed, state[n:])

    def batch(self, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> None:
        p = self.p
        q = p.t1.take(a, axis=0)
        q += p.t2.take(b, axis=0)
        noise = np.searchsorted(self.cumulative, self.rng.random(NOISE)).clip(0, CLASSES - 1)
        rw, rn = p.r.take(w, axis=0), p.r.take(noise, axis=0)
        shift = p.bias - self.log_expected
        one = np.ones(len(w), np.float32)
        gain = 1 / (1 + np.exp(np.clip(np.einsum("ij,ij->i", q, rw) + shift.take(w), -30, 30)))
        # -1 / (1 + exp(-score)), in place; the shift goes along as one more component, and exp may end in infinity, where the quotient is zero
        loss = np.matmul(np.column_stack([q, one]), -np.column_stack([rn, shift.take(noise)]).T, out=self.loss[: len(w)] if len(w) <= BATCH else None)
        with np.errstate(over="ignore"):
            np.exp(loss, out=loss)
        loss += 1
        np.divide(-1, loss, out=loss)
        gq = loss @ rn
        rw *= gain[:, None]
        gq += rw
        _rows_added(p.t1, _grouped(a), gq, self.squares[0])
        _rows_added(p.t2, _grouped(b), gq, self.squares[1])
        outcomes = _grouped(np.concatenate([w, noise]))
        _rows_added(p.r, outcomes, np.concatenate([gain[:, None] * q, loss.T @ q]), self.squares[2])
        _rows_added(p.bias, outcomes, np.concatenate([gain, one @ loss]), self.squares[3])
        self.seen += len(w)


def _classes(words: list[bytes], place: dict, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the head (-1: none) and classes of the words, the end last."""
    at = np.fromiter(map(place.get, words, repeat(-1)), np.intp, len(words))
    out = kind.take(at, mode="wrap") if len(kind) else np.zeros(len(words), np.int32)
    for i in np.flatnonzero(at < 0).tolist():
        out[i] = BUCKET_OF[words[i][-2:]]
    out[-1] = 0
    return at, out


_ready: dict = {}


def _prepared(key, make):
    if key not in _ready:
        _ready.clear()
        _ready[key] = make()
    return _ready[key]


class Head:
    """Look-ups of the head's words, and sums over a text's places in it (-1: none, which adds nothing)."""

    def __init__(self, v: Vocabulary):
        self.place, self.kind = v.tables()
        self.log_count = np.append(np.log10(v.counts + 0.5), 0.0)
        self.log_shared = self.log_count.copy()
        self.log_shared[np.flatnonzero(self.kind < CLASSES - BUCKETS)] = 0.0


def _read(shared):
    """Texts as outcomes: runs of at most CHUNK tokens, each after the two before it and with the replica it trains; and what the head's words add to the scores, and the rarer words."""

    def run(batches):
        name, v, replicas = shared.value
        t = _prepared(("v", name), lambda: Head(v))
        for batch in (b.slice(i, TEXTS) for b in batches for i in range(0, b.num_rows, TEXTS)):
            n, base, shared_logs, known = [], [], [], []
            rare_words, rare_counts, rare_ends = [], [], [0]
            cell, key, outcomes, ends = [], [], [], [0]
            for k, text in zip(batch.column(2).to_pylist(), batch.column(3).cast(pa.binary())):
                words = tokens(text.as_py() or b"")
                words.append(END)
                at, w = _classes(words, t.place, t.kind)
                unknown = np.flatnonzero(at < 0).tolist()
                n.append(len(words))
                known.append(len(words) - len(unknown))
                base.append(float(t.log_count[at].sum()))
                shared_logs.append(float(t.log_shared[at].sum()))
                rare = Counter([words[i] for i in unknown])
                rare_words += rare.keys()
                rare_counts += rare.values()
                rare_ends.append(len(rare_words))
                w = np.concatenate([[0, 0], w]).astype("<u2")
                for i in range(0, len(words), CHUNK):
                    key.append(zlib.crc32(i.to_bytes(8, "little"), k & 0xFFFFFFFF) | (k >> 32) << 32)
                    cell.append(zlib.crc32(key[-1].to_bytes(8, "little", signed=True)) % replicas)
                    outcomes.append(w[i : i + CHUNK + 2].tobytes())
                ends.append(len(outcomes))
            rare_column = pa.ListArray.from_arrays(pa.array(rare_ends, pa.int32()), pa.StructArray.from_arrays([pa.array(rare_words, pa.binary()), pa.array(rare_counts, pa.int32())], ["word", "n"]))
            runs = pa.StructArray.from_arrays([pa.array(cell, pa.int64()), pa.array(key, pa.int64()), pa.array(outcomes, pa.binary())], ["cell", "key", "outcomes"])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(shared_logs, pa.float64()), rare_column, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), runs)],
                ["doc_id", "held_out", "key", "n_tokens", "known", "base", "shared_logs", "rare", "runs"],
            )

    return run


def _trained(shared, seed: int):
    """The parameters of each replica whose rows the task has, one replica after the other."""

    def run(batches):
        noise, state = shared.value
        trainer, cell = None, None
        parts: list[np.ndarray] = []
        held = 0

        def drain():
            w, a, b = (np.concatenate([x[i : len(x) - 2 + i] for x in parts]).astype(np.int64) for i in (2, 1, 0))
            parts.clear()
            order = trainer.rng.permutation(len(w))
            w, a, b = w[order], a[order], b[order]
            for i in range(0, len(w), BATCH):
                trainer.batch(a[i : i + BATCH], b[i : i + BATCH], w[i : i + BATCH])

        def done():
            if parts:
                drain()
            out = trainer.state()
            cuts = range(0, len(out), SLICE)
            n = len(cuts)
            columns = [[cell] * n, [i // SLICE for i in cuts], [trainer.seen] * n]
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array([out[i : i + SLICE].tobytes() for i in cuts], pa.binary())], ["cell", "slice", "seen", "data"])

        for batch in batches:
            for c, outcomes in zip(batch.column(0).to_pylist(), batch.column(1)):
                if c != cell:
                    if trainer is not None:
                        yield done()
                    trainer, cell, held = Trainer.resumed(state, noise, seed * 1_000_003 + c), c, 0
                parts.append(np.frombuffer(outcomes.as_py(), "<u2"))
                held += len(parts[-1]) - 2
                if held >= 16 * BATCH:
                    drain()
                    held = 0
        if trainer is not None:
            yield done()

    return lean(run)


def _averaged(t: pa.Table) -> pa.Table:
    t = t.sort_by("cell")  # sums in one order, whatever the tasks were
    weight = t["seen"].to_numpy().astype(np.float64)
    total = 0.0
    for w, data in zip(weight, t["data"]):
        total = total + w * np.frombuffer(data.as_py(), np.float32)
    mean = (total / weight.sum()).astype(np.float32)
    return pa.table({"slice": pa.array([t["slice"][0].as_py()], pa.int64()), "data": pa.array([mean.tobytes()], pa.binary())})


class Tables:
    """Log-probabilities (base 10) of outcomes by their two contexts, normalised."""

    def __init__(self, v: Vocabulary, flat: np.ndarray):
        p = Parameters.of(flat)
        self.first = p.t1 @ p.r.T + p.bias
        self.second = p.t2 @ p.r.T
        m1, m2 = self.first.max(1), self.second.max(1)
        z = np.exp(self.first - m1[:, None]) @ np.exp(self.second - m2[:, None]).T
        self.norm = np.log(np.maximum(z, 1e-37)) + m1[:, None] + m2[None, :]
        self.within = v.within

    def log10(self, w: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a = a * CLASSES  # places in the flat tables
        b_w, a_w, a_b = b * CLASSES + w, a + w, a + b
        return (self.first.take(a_w).astype(np.float64) + self.second.take(b_w) - self.norm.take(a_b)) / np.log(10)


def _scored(shared):
    """Rows with the model's log-probability in place of their outcomes, the last column: a list of runs, of which each text has one at least."""

    def run(batches):
        name, v, flat = shared.value
        t = _prepared(("t", name), lambda: Tables(v, flat))
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            sums, parts, held = [], [], 0

            def drain():
                w, a, b = (np.concatenate([x[i : len(x) - 2 + i] for x in parts]).astype(np.intp) for i in (2, 1, 0))
                first = np.cumsum([0] + [len(x) - 2 for x in parts[:-1]])
                sums.append(np.add.reduceat(t.log10(w, a, b) - t.within.take(w), first))
                parts.clear()

            for outcomes in lists.flatten():
                parts.append(np.frombuffer(outcomes.as_py(), "<u2"))
                held += len(parts[-1]) - 2
                if held >= CHUNK:
                    drain()
                    held = 0
            if parts:
                drain()
            first = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)) - lists.value_lengths().to_numpy(zero_copy_only=False)
            model = np.add.reduceat(np.concatenate(sums), first) if sums else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model, pa.float64())], [*batch.schema.names[:-1], "model"])

    return run


def vocabulary(counts: DataFrame) -> tuple[Vocabulary, float]:
    """The head of the counts, and the logarithmic bin from which words may belong to it."""
    binned = counts.withColumn("bin", F.floor(F.log2("n") * 8))
    by_bin = sorted(((b, k, n) for b, k, n in binned.groupBy("bin").agg(F.count("*"), F.sum("n")).collect()), reverse=True)
    least, words = 0, 0
    for b, k, _ in by_bin:
        words += k
        if words > HEAD:
            least = b + 1
            break
    head = binned.where((F.col("bin") >= least) & (F.length("word") <= WORD_BYTES)).select("word", "n").toArrow()
    order = sorted(zip(head["word"].to_pylist(), head["n"].to_pylist()), key=lambda x: (x[0] == END, -x[1], x[0]))  # the end is no word of its own class
    words_, ns = [w for w, _ in order], np.array([n for _, n in order], np.int64)
    own = min(CLASSES - BUCKETS - 1, sum(w != END and n >= 5 for w, n in order))
    total, distinct = np.zeros(CLASSES), np.zeros(CLASSES)
    crc = F.pmod(F.crc32(F.substring("word", -2, 2)), F.lit(BUCKETS))
    for k, n, d in counts.where(F.length("word") > 0).groupBy(crc.alias("k")).agg(F.sum("n"), F.count("*")).collect():
        total[CLASSES - BUCKETS + k], distinct[CLASSES - BUCKETS + k] = n, d
    for i, w in enumerate(words_[:own]):
        total[bucket(w)] -= ns[i]
        distinct[bucket(w)] -= 1
        total[i + 1], distinct[i + 1] = ns[i], 1
    if words_ and words_[-1] == END:
        total[0], distinct[0] = ns[-1], 1
    return Vocabulary(words_, ns, sum(n for _, _, n in by_bin), sum(k for _, k, _ in by_bin), own, total, distinct), least


def learnt(training: DataFrame, v: Vocabulary) -> np.ndarray:
    """The model's parameters. ``training`` has key, a hash of the row, and runs."""
    sc = training.sparkSession.sparkContext
    noise = noise_of(v)
    state = Trainer(start(v), noise, 0).state()
    for k in range(ROUNDS):
        rows = training.where(F.pmod(F.xxhash64("key", F.lit("round")), F.lit(ROUNDS)) == k).select(F.explode("runs").alias("run")).select("run.*")
        dealt = rows.repartition(F.col("cell")).sortWithinPartitions("cell", "key", "outcomes")
        shared = sc.broadcast((noise, state))
        trained = dealt.select("cell", "outcomes").mapInArrow(_trained(shared, k + 1), "cell long, slice long, seen long, data binary")
        got = trained.groupBy("slice").applyInArrow(_averaged, "slice long, data binary").toArrow()
        parts = sorted(zip(got["slice"].to_pylist(), got["data"].to_pylist()))
        if parts:
            state = np.concatenate([np.frombuffer(x, np.float32) for _, x in parts])
        shared.unpersist()
    return state[: len(state) - 4 * CLASSES]


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held: int = 1) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "lm")
    held_out = fold_of(id_col, folds) == held
    counts = scratch.write(docs.where(~held_out).select(text_col).mapInArrow(lean(_counted), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    v, least = vocabulary(counts)
    replicas = int(min(REPLICAS, max(1, v.total // (ROUNDS * REPLICA_TOKENS))))
    named = spark.sparkContext.broadcast((uuid.uuid4().hex, v, replicas))
    given = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), F.xxhash64(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()
    columns = f"doc_id {kind}, held_out boolean, n_tokens long, known long, base double"
    read = given.mapInArrow(_read(named), columns.replace("n_tokens", "key long, n_tokens") + ", shared_logs double, rare array<struct<word: binary, n: int>>, runs array<struct<cell: long, key: long, outcomes: binary>>")
    parts = scratch.write(read.withColumn("row", F.monotonically_increasing_id()), "parts")
    flat = learnt(parts.where(~F.col("held_out")), v)
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, replace(v, words=[], counts=v.counts[:0]), flat))
    scored = parts.select("doc_id", "held_out", "n_tokens", "known", "base", "shared_logs", "row", "runs.outcomes").mapInArrow(_scored(shared), f"{columns}, shared_logs double, row long, model double")
    tail = counts.where((F.floor(F.log2("n") * 8) < least) | (F.length("word") > WORD_BYTES)).withColumnRenamed("n", "c")
    rare = parts.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.n").join(tail, "word", "left")
    logs = F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))
    rare = rare.groupBy("row").agg(F.sum(F.col("n") * logs).alias("rare_logs"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("rare_known"))
    out = scored.join(rare, "row", "left").fillna(0, ["rare_logs", "rare_known"])
    unit = float(np.log10(v.total + 0.5 * (v.distinct + 1)))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.col("rare_known")).alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("rare_logs") - F.col("n_tokens") * F.lit(unit)).alias("base_score"), (F.col("model") + F.col("shared_logs") + F.col("rare_logs")).alias("score"),
    )


def op1_nce_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
