"""Removal of word runs that a document with a smaller id also has.

A window is ``WINDOW`` consecutive words. Its key is the smallest hash of the
``GRAM``-word runs in it, so equal windows have equal keys, and neighbouring
windows mostly share one. A count-min sketch over the keys of each document,
merged from all tasks, overestimates in how many documents a window stands; only
windows that it puts at two or more go on. The sketch grows with the corpus; a
small one is broadcast, a larger one stays in its chunks, to which keys are sent.

Neighbouring windows with one key are a stretch, and a stretch goes on as one
row: its key and a 96-bit hash of all its words. A stretch that a smaller id also
has is removed whole. Equal windows have one key, so a key that has one stretch
only, in however many documents, is settled. What is left are the first documents
of the stretches that share a key but differ, as at the ends of a passage; their
windows go on one by one, are grouped exactly by a 96-bit hash of their words,
smallest id first, and a window whose group has a smaller id than its document's
is removed. A later document of such a stretch has it removed whole, and no
window of it is needed, as the first document sends the same ones with a smaller
id. So is every word removed that a removed window covers.

Joins that bring ids back to stretches and windows have unique rows on one side,
so Spark can split the other.

Defined cases: a null text has no words; a null id neither removes nor loses
anything; rows that repeat id and text get the same result and do not remove
each other; other columns pass through, but for input columns named like the
results or with the names in ``INSIDE``, which are dropped. An empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sketch
from .common import Scratch, lean, small_batches, table
from .sketch import DEPTH, HASHES, Powers, Touched, chunks_for, gathered, looked_up, maybe_repeated, mixed, places, repeated_bits, running_min

WINDOW, GRAM = 50, 8
#: Cells of the sketch that a task combines before it passes them on.
PENDING = 1 << 20
RUNS = "key long, h1 long, h2 int, __id long, __code long, at int, n int"

_powers, _second = Powers(), Powers(0xC2B2AE3D27D4EB4F | 1)


def words_of(text: bytes | None) -> list[bytes]:
    return text.split() if text else []


def window_keys(h: np.ndarray, window: int) -> np.ndarray:
    gram = min(GRAM, window)
    return running_min(_powers.windows(h, gram), window - gram + 1)


def _touching(window: int, chunks: int):
    def run(batches):
        touched = Touched(chunks)
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                words = words_of(text.as_py())
                if len(words) >= window:
                    touched.add(np.unique(window_keys(HASHES.of(words), window)))
                    if touched.held > PENDING:
                        yield touched.batch()
        if touched.held:
            yield touched.batch()

    return lean(run, HASHES)


def _asking(window: int, chunks: int):
    """A row for each distinct key of a document: where its cells are."""

    def run(batches):
        for batch in batches:
            for doc_id, code, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
                words = words_of(text.as_py())
                if len(words) >= window:
                    keys = np.unique(window_keys(HASHES.of(words), window))
                    chunk, at = places(keys, chunks)
                    columns = [np.full(len(keys), doc_id, np.int64), np.full(len(keys), code, np.int64), keys.view(np.int64), chunk, *at]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["__id", "__code", "key", "chunk", *(f"at{row}" for row in range(DEPTH))])

    return lean(_batched(run), HASHES)


class Filter:
    """Which keys of a document may be repeated: by the broadcast filter, or by the list that came with the document."""

    def __init__(self, shared=None, chunks: int = 0):
        self.shared, self.chunks = shared, chunks

    def passes(self, keys: np.ndarray, own: pa.Scalar | None) -> np.ndarray:
        if self.shared is not None:
            return maybe_repeated(keys, self.shared.value, self.chunks)
        return np.isin(keys, np.asarray(own.values).view(np.uint64)) if own.is_valid else np.zeros(len(keys), bool)


def _runs(window: int, keep: Filter):
    """A row for each stretch of windows with one key that may be repeated: its key, the hash of all its words, where it begins and how many windows it has."""

    def run(batches):
        for batch in batches:
            parts = []
            for doc_id, code, text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), batch.column(3)):
                words = words_of(text.as_py())
                if len(words) < window:
                    continue
                h = HASHES.of(words)
                keys = window_keys(h, window)
                at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                n = np.diff(np.append(at, len(keys)))
                passed = keep.passes(keys[at], own)
                at, n = at[passed], n[passed]
                if len(at):
                    parts.append((keys[at].view(np.int64), *hashes(h, at, at + n + window - 1), np.full(len(at), doc_id, np.int64), np.full(len(at), code, np.int64), at.astype(np.int32), n.astype(np.int32)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], [x.split()[0] for x in RUNS.split(", ")])

    return lean(run, HASHES)


def hashes(h: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two parts of the hash of each stretch of words."""
    return _powers.spans(h, begin, end).view(np.int64), (_second.spans(mixed(h, 5), begin, end) >> np.uint64(33)).astype(np.int32)


def _windows(window: int):
    """A row for each window of the stretches asked for."""

    def run(batches):
        for batch in batches:
            for doc_id, code, text, asks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), batch.column(3)):
                first, n = (asks.values.field(i).to_numpy() for i in (0, 1))
                at = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
                one, two = hashes(HASHES.of(words_of(text.as_py())), at, at + window)
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.array(np.full(len(at), doc_id, np.int64)), pa.array(np.full(len(at), code, np.int64)), pa.array(at.astype(np.int32))], ["h1", "h2", "__id", "__code", "at"])

    return lean(_batched(run), HASHES)


def _batched(run, rows: int = 100_000):
    """The record batches of ``run`` in fewer, larger ones."""

    def out(batches):
        parts, held = [], 0
        for b in run(batches):
            parts.append(b)
            held += b.num_rows
            if held >= rows:
                yield from pa.Table.from_batches(parts).combine_chunks().to_batches()
                parts, held = [], 0
        if parts:
            yield from pa.Table.from_batches(parts).combine_chunks().to_batches()

    return out


def _cut(names: list[str], text_at: int, starts_at: int, window: int):
    def run(batches):
        for batch in batches:
            kept, n_words, n_removed = [], [], []
            for text, starts in zip(batch.column(text_at).cast(pa.binary()), batch.column(starts_at)):
                words = words_of(text.as_py())
                n_words.append(len(words))
                if starts.is_valid:
                    at, n = (starts.values.field(i).to_numpy() for i in (0, 1))
                    edge = np.bincount(at, minlength=len(words) + 1) - np.bincount(at + n - 1 + window, minlength=len(words) + 1)
                    stays = np.cumsum(edge[:-1]) == 0
                    words = [w for w, s in zip(words, stays.tolist()) if s]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            texts = pa.array(kept, pa.binary())
            columns = [batch.column(i) for i in range(len(names))]
            shas = pa.array([hashlib.sha256(x).hexdigest() for x in kept])
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), texts.cast(pa.string()), shas], [*names, "n_words", "n_removed", "kept_text", "kept_sha256"])

    return run


def with_filter(given: DataFrame, scratch: Scratch, window: int) -> tuple[DataFrame, Filter]:
    """(__id, __code, text, own) of the documents that may lose words, and what tells their repeated keys: a filter, or ``own``."""
    chars = given.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    chunks = chunks_for(chars / 5 / 20)
    bits = repeated_bits(given.select("text").mapInArrow(_touching(window, chunks), "chunk long, places binary, counts binary"))
    if chunks * sketch.CHUNK * DEPTH // 8 <= sketch.BROADCAST:
        return given.withColumn("own", F.lit(None).cast("array<long>")), Filter(given.sparkSession.sparkContext.broadcast(gathered(bits, chunks)), chunks)
    asked = given.mapInArrow(_asking(window, chunks), "__id long, __code long, key long, chunk long, " + ", ".join(f"at{row} long" for row in range(DEPTH)))
    own = looked_up(asked, scratch.write(bits, "bits")).groupBy("__id", "__code").agg(F.collect_set("key").alias("own"))
    return scratch.write(given.join(own, ["__id", "__code"]).select("__id", "__code", "text", "own"), "marked"), Filter()


def removed_windows(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """(__id, __code, __starts): where the windows to remove begin, and how many follow each other there, by id and hash of the text."""
    given = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("__id"), F.xxhash64(text_col).alias("__code"), F.col(text_col).alias("text"))
    given, keep = with_filter(given, scratch, window)
    place = ["__id", "__code", "at", "n"]
    runs = scratch.write(given.mapInArrow(_runs(window, keep), RUNS), "runs")
    same = ["key", "h1", "h2"]
    firsts = scratch.write(runs.groupBy(*same).agg(F.min("__id").alias("low")), "firsts")
    several = firsts.groupBy("key").agg(F.count("*").alias("several")).where(F.col("several") > 1)
    firsts = firsts.join(scratch.write(several, "several"), "key", "left")
    told = runs.join(scratch.write(firsts, "told"), same)
    told = scratch.write(told.where((F.col("low") < F.col("__id")) | F.col("several").isNotNull()).select(*place, (F.col("low") < F.col("__id")).alias("whole")), "places")
    asks = told.where(~F.col("whole")).groupBy("__id", "__code").agg(F.collect_set(F.struct("at", "n")).alias("asks"))
    each = given.select("__id", "__code", "text").join(asks, ["__id", "__code"]).mapInArrow(_windows(window), "h1 long, h2 int, __id long, __code long, at int")
    each = scratch.write(each, "windows")
    groups = each.groupBy("h1", "h2").agg(F.min("__id").alias("low"), F.max("__id").alias("high")).where(F.col("low") < F.col("high")).select("h1", "h2", "low")
    hit = each.join(scratch.write(groups, "groups"), ["h1", "h2"]).where(F.col("low") < F.col("__id"))
    hit = told.where("whole").select(*place).unionByName(hit.select("__id", "__code", "at", F.lit(1).alias("n")))
    return hit.groupBy("__id", "__code").agg(F.collect_list(F.struct("at", "n")).alias("__starts"))


#: What the operator adds, and names it uses inside; input columns of these names are dropped.
ADDED = ("n_words", "n_removed", "kept_text", "kept_sha256")
INSIDE = ("__id", "__code", "__code2", "__of", "__starts")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with n_words, n_removed, kept_text (kept words, single spaces) and kept_sha256."""
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "substrings")
    kept = docs.drop(*[c for c in (*ADDED, *INSIDE) if c not in (id_col, text_col)])
    starts = removed_windows(kept, scratch, id_col, text_col, window)
    names = kept.columns
    keyed = kept.withColumn("__code", F.xxhash64(text_col)).withColumn("__of", F.col(id_col).cast("long"))
    joined = keyed.join(starts.withColumnRenamed("__code", "__code2"), (F.col("__of") == F.col("__id")) & (F.col("__code") == F.col("__code2")), "left").select(*names, "__starts")
    schema = T.StructType([*kept.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("kept_sha256", T.StringType())])
    return joined.mapInArrow(lean(_cut(names, names.index(text_col), len(names), window)), schema)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


#: The same by SQL: every window by the hash of its words, the smallest id of each, and the words that the windows to remove cover.
OP9_SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50)),
f AS (SELECT h, min(doc_id) AS first FROM w GROUP BY h),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS j FROM w JOIN f USING (h) WHERE first < doc_id),
lost AS (SELECT r, list(j) AS js FROM gone GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed, sha256(array_to_string(CASE WHEN js IS NULL THEN ws ELSE list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda x: NOT list_contains(js, x[2])), lambda x: x[1]) END, ' ')) AS kept_sha256 FROM d LEFT JOIN lost USING (r)"""
