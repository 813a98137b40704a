"""Best-fit packing of tokenised documents by a configuration linear program.

Tokens. ``byte_bpe_50k`` ids, then id 2. A word after a single space is encoded
alone: the tokenizer's pre-splitter never joins what such a space parts, so its
ids are looked up in a bounded cache. Texts with other white space next to a
space, or with a special token's string, are encoded whole.

Plan. Only the histogram of piece lengths reaches the driver, at most
``capacity`` numbers at any corpus size. The configuration LP (how often to use
each multiset of lengths that fits a sequence) is solved by multiplicative
weights; a knapsack dynamic program over the lengths prices the next
configurations. The fractional solution is moved to a vertex, which has no more
configurations than there are lengths, and rounded; bins with room left and the
lengths not yet placed are finished by best fit decreasing over the histogram.
No plan is longer than best fit alone.

Placement. A piece's rank among the pieces of its length picks its slot in the
plan. Ranks come from counts salted by row, so a length that a third of all
pieces have, or that many rows repeat, is dealt to many tasks.

Nulls: a null text is empty, one token. Repeated rows are separate documents. An
empty table gives an empty result. Columns other than id and text are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import Scratch, lean, small_batches, table

CAPACITY = 1024
END_ID = 2
#: Rounds of the multiplicative weights; fractions that the roundings tried round up.
ROUNDS, ROUNDINGS = 240, (0.0, 0.25, 0.5, 1.0)
#: Changes of the vertex that enter its inverse at a time; after so many such blocks it is refined.
BLOCK, REFINED = 64, 8
#: Pieces of one length that are ranked in one task.
SALTED = 20_000
#: Words whose ids a worker keeps at most.
CACHED_WORDS = 400_000
#: Words of which one is empty or has white space at an edge.
EDGE = re.compile(r"(?:^|\0)(?:[\s\0]|$)|\s(?:\0|$)")
#: Texts encoded at a time.
TEXTS = 128


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Little-endian 32-bit ids of texts, as the tokenizer file gives them.

    The file's vocabulary as ranks (same ids, several times as fast) encodes
    what holds no special token's string; the file itself encodes the rest.
    """

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.spaced = np.zeros(max(ranks.values()) + 1, bool)
        self.spaced[[rank for token, rank in ranks.items() if token.startswith(b" ")]] = True
        self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes | None] = {}

    def whole(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self.ranks.encode_ordinary(text), "<u4").tobytes()

    def learn(self, words: set[str]) -> bool:
        """Ids of words after a space; None for what is no word between single spaces. False: the cache was full and began anew."""
        full = bool(self.known) and len(self.known) + len(words) > CACHED_WORDS
        if full:
            self.known.clear()
        plain = list(words)
        if EDGE.search("\0".join(plain)):
            plain = [w for w in words if w and not w[0].isspace() and not w[-1].isspace()]
            self.known.update(dict.fromkeys(words - set(plain)))
        if plain:
            ids = np.array(self.ranks.encode_ordinary(" " + " ".join(plain)), "<u4")
            first = (4 * np.flatnonzero(self.spaced[ids])).tolist()  # no word has a space but the one before it
            data = ids.tobytes()
            self.known.update(zip(plain, [data[i:j] for i, j in zip(first, [*first[1:], len(data)])], strict=True))
        return not full

    def __call__(self, texts: list[str]) -> list[bytes]:
        split = [t.split(" ") for t in texts]
        seen = set().union(*split)
        new = seen - self.known.keys()
        if new and not self.learn(new):
            self.learn(seen)
        out, ids_of = [], self.known.__getitem__
        for text, words in zip(texts, split):
            try:
                if any(s in text for s in self.special) or self.known[words[0]] is None:
                    raise TypeError
                out.append(self.whole(words[0]) + b"".join(map(ids_of, words[1:])))
            except TypeError:
                out.append(self.whole(text))
        return out


_encoders: dict[str, Encoder] = {}


def _pieces(path: str, capacity: int):
    def run(batches):
        encode = _encoders.get(path) or _encoders.setdefault(path, Encoder(path))
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                coded = encode([t or "" for t in part.column(1).to_pylist()])
                for doc_id, ids in zip(part.column(0).to_pylist(), coded):
                    ids += end
                    n = len(ids) // 4
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        for column, value in zip(out, (doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b]))):
                            column.append(value)
            types = (batch.schema.types[0], pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return lean(run)


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32); the first piece of a cut document is the short one."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_pieces(path or tokenizer_path(), capacity), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def price(value: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """An unbounded knapsack: the most value that each room holds, and which length it takes first (place + 1; 0: none)."""
    best, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        k = upto[c]
        best[c] = best[c - 1]
        if k:
            total = best[c - lengths[:k]] + value[:k]
            i = int(total.argmax())
            if total[i] > best[c]:
                best[c], pick[c] = total[i], i + 1
    return best, pick


def packed(config) -> bytes:
    """A configuration, (place, times) of its lengths, in a few bytes: tens of thousands are held."""
    return np.array(config, "<u2").tobytes()


def unpacked(config: bytes) -> np.ndarray:
    return np.frombuffer(config, "<u2").reshape(-1, 2)


def fractional(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[dict[bytes, float], float]:
    """A fractional solution of the configuration LP within the demand, and a lower bound of sequences from its dual.

    Multiplicative weights on the demands: a length's price is its tokens times a
    weight that rises with how far its cover lags behind a common schedule. Each
    round the knapsack gives, for every length that lags, the dearest
    configuration through it; that is used until the length is on schedule or
    one of its lengths is used up.
    """
    covered, weight, bound = np.zeros(len(demand)), np.zeros(len(demand)), 0.0
    jitter = np.random.default_rng(0)
    uses: dict[bytes, float] = defaultdict(float)
    for k in range(ROUNDS):
        live = np.flatnonzero(demand - covered > 1e-6 * demand)
        if not live.size:
            break
        due = min(1.0, (k + 1) / (0.95 * ROUNDS))
        value = lengths[live] / capacity * np.exp(weight[live]) * (1 + 0.002 * jitter.random(live.size))  # else ties always take the same fillers
        best, pick = price(value, lengths[live], capacity)
        if live.size == len(lengths):
            bound = max(bound, float(value @ demand / best[capacity]))
        for i in np.argsort(-(value + best[capacity - lengths[live]]), kind="stable").tolist():
            lacks = due * demand[live[i]] - covered[live[i]]
            if lacks <= 1e-9 * demand[live[i]]:
                continue
            config = configuration(i, pick, lengths[live], capacity)
            amount = min(lacks / dict(config)[i], *((demand[live[j]] - covered[live[j]]) / q for j, q in config))
            if amount > 0:
                for j, q in config:
                    covered[live[j]] += amount * q
                uses[packed([(live[j], q) for j, q in config])] += amount
        weight = np.clip(due - covered / demand, -1.0, 1.0)
    return uses, bound


class Vertex:
    """A basic solution of the LP, slacks of uncovered pieces included; it uses no more configurations than there are lengths."""

    def __init__(self, lengths: np.ndarray, level: np.ndarray, capacity: int):
        self.lengths, self.capacity, self.level = lengths, capacity, level
        self.inverse, self.basic = np.eye(len(lengths)), [None] * len(lengths)
        self.left, self.right = np.zeros((len(lengths), BLOCK)), np.zeros((BLOCK, len(lengths)))  # the inverse is inverse - left @ right
        self.cost = 1.1 * lengths / capacity  # of a basic slack; a configuration costs 1
        self.pivots = 0

    def move(self, config: bytes, x: float) -> None:
        """``config``, used ``x`` times so far, goes where less is left uncovered, until it or a basic one reaches zero."""
        pairs = unpacked(config)
        held, times = self.pivots % BLOCK, pairs[:, 1].astype(float)
        w = self.inverse[:, pairs[:, 0]] @ times - self.left[:, :held] @ (self.right[:held, pairs[:, 0]] @ times)
        up = 1.0 - self.cost @ w < -1e-9
        if not up and not x:
            return
        fall = w if up else -w
        falls = np.flatnonzero(fall > 1e-9)
        ratio = self.level[falls] / fall[falls]
        step = float(ratio.min()) if falls.size else np.inf
        if not up and step >= x:
            self.level -= x * fall
            return
        out = int(falls[ratio.argmin()])
        self.level -= step * fall
        self.level[out] = x + (step if up else -step)
        self.basic[out], self.cost[out] = config, 1.0
        self.right[held] = (self.inverse[out] - self.left[out, :held] @ self.right[:held]) / w[out]
        self.left[:, held] = w
        self.left[out, held] -= 1.0
        self.pivots += 1
        if self.pivots % BLOCK == 0:
            self.inverse -= self.left @ self.right
            if self.pivots % (REFINED * BLOCK) == 0:
                self.refine()

    def residual(self) -> np.ndarray:
        """How far basis times inverse is from the identity; the basis has a few numbers a column, so this is a sum of few rows."""
        out = np.eye(len(self.lengths))
        for place, config in enumerate(self.basic):
            if config is None:
                out[place] -= self.inverse[place]  # a slack never comes back, so it stands at its own length
            else:
                for i, q in unpacked(config).tolist():
                    out[i] -= q * self.inverse[place]
        return out

    def refine(self) -> None:
        """Newton steps on the inverse, which only has rounding errors to lose.

        No inversion by LAPACK: the threaded one does not return in a process that has started a JVM.
        """
        for _ in range(4):
            wrong = self.residual()
            if np.abs(wrong).max() < 1e-9:
                return
            self.inverse += self.inverse @ wrong


def configuration(first: int, pick: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple:
    """The dearest configuration through a length: (place, times) of its lengths."""
    config, room = {first: 1}, capacity - int(lengths[first])
    while room > 0:
        j = int(pick[room]) - 1
        if j >= 0:
            config[j] = config.get(j, 0) + 1
        room -= int(lengths[j]) if j >= 0 else 1
    return tuple(sorted(config.items()))


def vertex(uses: dict[bytes, float], lengths: np.ndarray, demand: np.ndarray, capacity: int) -> dict[bytes, float]:
    """The solution moved to a vertex, one configuration at a time."""
    covered = np.zeros(len(lengths))
    for c, x in uses.items():
        pairs = unpacked(c)
        covered[pairs[:, 0]] += x * pairs[:, 1]
    at = Vertex(lengths, np.maximum(demand - covered, 0.0), capacity)
    for c in sorted(uses, key=lambda c: (-uses[c], c)):
        at.move(c, uses[c])
    return {c: float(v) for c, v in zip(at.basic, at.level) if c is not None and v > 1e-9}


def configuration_lp(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[dict[tuple, float], float]:
    """Fractional uses of configurations ((length, times), ...), and a lower bound of the sequences that ``counts`` need."""
    need = {n: c for n, c in counts.items() if 0 < n <= capacity and c > 0}
    whole = need.pop(capacity, 0)
    if not need:
        return {}, float(whole)
    lengths = np.array(sorted(need))
    demand = np.array([need[n] for n in lengths.tolist()], float)
    uses, bound = fractional(lengths, demand, capacity)
    found = vertex(uses, lengths, demand, capacity)
    return {tuple((int(lengths[i]), q) for i, q in unpacked(c).tolist()): v for c, v in found.items()}, whole + bound


def rounded(uses: dict[tuple, float], counts: dict[int, int], up: float) -> list[tuple[tuple, int]]:
    """Whole uses within ``counts``: the most used first, fractions from 1 - ``up`` on rounded up."""
    left, out = dict(counts), []
    for config, x in sorted(uses.items(), key=lambda t: (-t[1], t[0])):
        m = min([int(x + up + 1e-6), *(left.get(n, 0) // k for n, k in config)])
        if m > 0:
            for n, k in config:
                left[n] -= k * m
            out.append((config, m))
    return out


def pack_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Configurations and how many sequences use each; together they hold exactly ``counts``.

    Of the LP's roundings, each finished by best fit, and of best fit alone, the plan of fewest sequences.
    """
    uses, _ = configuration_lp(counts, capacity)
    plans = [finished(rounded(uses, counts, up), counts, capacity) for up in ROUNDINGS]
    return min([*plans, finished([], counts, capacity)], key=lambda plan: sum(m for _, m in plan))


def finished(fixed: list[tuple[tuple, int]], counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """The plan with the configurations ``fixed`` and the rest by best fit decreasing."""
    left = {n: c for n, c in counts.items() if c > 0}
    bins: dict[int, list[tuple[dict[int, int], int]]] = defaultdict(list)
    if left.get(capacity):
        bins[0].append(({capacity: 1}, left.pop(capacity)))
    for config, m in fixed:
        for n, k in config:
            left[n] -= k * m
        bins[capacity - sum(n * k for n, k in config)].append((dict(config), m))
    for n in sorted(left, reverse=True):
        todo = left[n]
        for room in range(n, capacity):
            while todo and bins.get(room):
                config, m = bins[room].pop()
                used = min(m, todo)
                if m > used:
                    bins[room].append((config, m - used))
                bins[room - n].append((config | {n: config.get(n, 0) + 1}, used))
                todo -= used
                if room - n >= n:  # the room that is left is the best fit for the next one
                    more = min(used * ((room - n) // n), todo)
                    per = more // used
                    if per:
                        config, m = bins[room - n].pop()
                        bins[room - n - per * n].append((config | {n: config[n] + per}, m))
                        todo -= per * used
            if not todo:
                break
        per = capacity // n
        if todo >= per:
            bins[capacity - per * n].append(({n: per}, todo // per))
        if todo % per:
            bins[capacity - (todo % per) * n].append(({n: todo % per}, 1))
    return [x for room in sorted(bins) for x in bins[room]]


def _slots(plan: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """For each length, which ranks a configuration's slots take."""
    rows, taken, sequence = [], defaultdict(int), 0
    for config, m in plan:
        offset = 0
        for n, k in sorted(config.items(), reverse=True):
            rows.append((n, taken[n], k, sequence, offset))
            taken[n] += k * m
            offset += n * k
        sequence += m
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return {"key": (columns[0] << 48) + columns[1], "first": columns[1], "per": columns[2], "sequence": columns[3], "offset": columns[4]}


def _placed(slots: dict[str, np.ndarray]):
    def run(batches):
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            i = np.searchsorted(slots["key"], (length << 48) + rank, side="right") - 1
            at = rank - slots["first"][i]
            per = slots["per"][i]
            kept = [c for c in batch.schema.names if c != "rank"]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(slots["sequence"][i] + at // per), pa.array(slots["offset"][i] + at % per * length)], [*kept, "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (written, with ``length`` and a unique ``row``) with sequence_id and offset in place of ``row``."""
    counts = {n: c for n, c in pieces.groupBy("length").count().collect()}
    kept = [f for f in pieces.schema.fields if f.name != "row"]
    schema = T.StructType([*kept, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    if not counts:
        return pieces.drop("row").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    salts = pieces.sparkSession.createDataFrame([(n, -(-c // SALTED)) for n, c in counts.items()], "length long, salts long")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("row"), F.col("salts"))).drop("salts")
    cells = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1))
    cells = cells.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(W.partitionBy("length", "salt").orderBy("row"))
    ranks = salted.withColumn("own", own).join(cells, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("own") - 1)
    ranks = ranks.select(*[f.name for f in kept], "rank")
    return ranks.mapInArrow(_placed(_slots(pack_plan(counts, capacity))), schema)


def packed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "pack")
    pieces = token_pieces(docs, id_col, text_col, path, capacity).withColumn("row", F.monotonically_increasing_id())
    return pack(scratch.write(pieces, "pieces"), capacity)


def op4_config_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))
