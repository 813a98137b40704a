"""Spelling variants: words one edit apart, and the common form that each belongs to.

Words. Tasks split texts with a byte table (a run of letters is a word) and add
up their counts before anything is shuffled. For one run in ``ERASED``, chosen
by a checksum of document and run, one letter is left out first.

Index. A word gives its q-grams with their places. The grams of two words that
are one edit apart differ in at most ``Q`` of either word's, so they share at
least ``shared_at_least`` of them, in place, or one place on in the longer word.
Gram counts over all words order the grams, rare first; two such words then
share a gram among the first ``Q + 1`` of each, at an allowed place. A word is
posted under those grams, by (gram, length, place), and looks itself up under
its own length and, one place on or not, under the next length.

Merge. In each (gram, length, place) the posted words' grams form an inverted
index. For a word that looks itself up, the postings of its grams, within the
limits of length and place, are merged by a heap; the longest lists, one fewer
than the bound asks, are left out of it, as a word that only they hold does not
reach the bound. What the merge yields is verified letter by letter. The list of
the key's own gram, which holds every posted word, counts one and is not merged;
of a few posted words all are verified. Of two posted words the later looks up
the earlier. Postings of more
than ``POSTED`` words are dealt to several tasks, each of which all lookups
visit, so no task holds more and no pair is lost.

Forms. A word's form is its near word of most occurrences (ties: first in code
point order) if that has ``TIMES`` as many; the last form of a chain is the
root, found by doubling steps (a chain cannot be longer than the logarithm of
the largest count).

Defined cases: a null text has no words, a null id counts as empty text in the
checksum; repeated rows count each; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter, defaultdict
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, lean, small_batches, table

#: Letters are single bytes in Latin-1: A-Z, a-z and U+00C0 to U+00FF.
LETTERS = bytes(range(0x61, 0x7B)) + bytes(range(0xC0, 0x100))
SPLIT = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in LETTERS else 0x20 for c in range(256))
NUMBER = np.full(256, len(LETTERS), np.int64)
NUMBER[list(LETTERS)] = np.arange(len(LETTERS))
#: One run in so many loses a letter.
ERASED = 199
LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
Q = 3
GRAMS = len(LETTERS) ** Q
#: Distinct words that a task adds up at a time, words posted together in one task.
PENDING, POSTED = 1 << 18, 4096
#: Posted words of a key that are verified without a merge, and rows of a task that merges.
FEW, ROWS = 3, 100_000


def words_of(text: str) -> list[bytes]:
    """The runs of letters, A-Z lower-cased, in Latin-1."""
    return text.encode("latin-1", "replace").translate(SPLIT).split()


def erased(word: bytes, start: int) -> bytes:
    """The word without a letter, if the checksum that goes on from ``start`` says so."""
    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
    if h % ERASED:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def _counted(least: int):
    def run(batches):
        total: defaultdict[bytes, int] = defaultdict(int)

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                start = zlib.crc32(f"{doc_id or ''}:".encode())
                for word, n in Counter([w for w in words_of(text) if len(w) >= least]).items():
                    word = erased(word, start)
                    if len(word) >= least:
                        total[word] += n
                if len(total) > PENDING:
                    yield flush()
        if total:
            yield flush()

    return lean(run)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of at least so many letters and occurrences."""
    small_batches(docs.sparkSession)
    given = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return given.mapInArrow(_counted(least_length), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def grams_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, place, gram) of every q-gram of a list of words."""
    letters = NUMBER[np.frombuffer(b" ".join(words) + b" " * Q, np.uint8)]
    length = np.array([len(w) for w in words])
    code = np.zeros(len(letters) - Q, np.int64)
    for i in range(Q):
        code = code * len(LETTERS) + letters[i : len(code) + i]
    count = np.maximum(length - Q + 1, 0)
    word = np.repeat(np.arange(len(words)), count)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    begin = np.cumsum(length + 1) - length - 1
    return word, place, code[begin[word] + place]


def _gram_counts(batches):
    total = np.zeros(GRAMS, np.int64)
    for batch in batches:
        words = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
        if words:
            np.add.at(total, grams_of(words)[2], 1)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["gram", "n"])


def gram_ranks(words: DataFrame) -> np.ndarray:
    """The rank of each gram, rare first. There are GRAMS at most, whatever the corpus."""
    counts = words.select("word").mapInArrow(_gram_counts, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(GRAMS, np.int64)
    total[counts["gram"].to_numpy()] = counts["n"].to_numpy()
    rank = np.empty(GRAMS, np.int32)
    rank[np.argsort(total, kind="stable")] = np.arange(GRAMS, dtype=np.int32)
    return rank


KEY = ["gram", "length", "place"]
POSTINGS = "gram int, length int, place int, asks boolean, word string, n long"


def _posted(shared):
    """Rows of a word: posted under its first Q + 1 grams, and asking, under Q of them, in the words one longer."""

    def run(batches):
        rank = shared.value
        for batch in batches:
            text = batch.column(0).to_pylist()
            words = [w.encode("latin-1") for w in text]
            if not words:
                continue
            word, place, gram = grams_of(words)
            order = np.lexsort((place, rank[gram], word))
            word, place, gram = word[order], place[order], gram[order]
            nth = np.arange(len(word)) - np.searchsorted(word, word)
            length = np.array([len(w) for w in words])[word]
            home, asks = nth <= Q, nth < Q
            of = np.concatenate([word[home], word[asks], word[asks]])
            ask = np.arange(len(of)) >= home.sum()
            columns = (
                np.concatenate([gram[home], gram[asks], gram[asks]]),
                np.concatenate([length[home], length[asks] + 1, length[asks] + 1]),
                np.concatenate([place[home], place[asks], place[asks] + 1]),
            )
            numbers = [pa.array(c.astype(np.int32)) for c in columns]
            yield pa.RecordBatch.from_arrays([*numbers, pa.array(ask), batch.column(0).take(pa.array(of)), batch.column(1).take(pa.array(of))], [x.split()[0] for x in POSTINGS.split(", ")])

    return run


def dealt(posted: DataFrame, most: int) -> DataFrame:
    """``posted`` with a ``salt``: of a key with more than ``most`` words each salt has a share, which every asking word and every other share's word visit."""
    sizes = posted.where(~F.col("asks")).groupBy(*KEY).count().where(F.col("count") > most)
    large = sizes.select(*KEY, F.ceil(F.col("count") / most).cast("int").alias("salts"))
    rows = posted.join(large, KEY, "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("salts")).cast("int")
    rows = rows.withColumn("own", F.when(~F.col("asks"), own)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    return rows.withColumn("asks", F.col("asks") | (F.col("salt") != F.col("own"))).select(*KEY, "salt", "asks", "word", "n")


def shared_at_least(longest: int) -> int:
    """Grams, with their places, that two words one edit apart share at least."""
    return longest - 2 * Q + 1


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether exactly one letter inserted, deleted or replaced makes one of the other."""
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) <= 1 and _apart_by_one(int.from_bytes(a), int.from_bytes(b), len(b) - len(a))


def _apart_by_one(x: int, y: int, longer: int) -> bool:
    """The same of words as numbers, a byte a letter; the second is ``longer`` by no letter or one."""
    if not longer:
        apart = x ^ y
        return bool(apart) and apart >> ((apart & -apart).bit_length() - 1 & -8) < 256  # one byte differs
    after = ((x << 8 ^ y).bit_length() - 1) // 8 * 8  # bits behind the first letter that is not the shorter word's
    below = (1 << after) - 1
    return not (x ^ y) & below


class Index:
    """The posted words of a key: an inverted list, in rising order of words, for each gram and place but the key's own."""

    def __init__(self, words: list[bytes], place: int, length: int = 0, expected: int = 0):
        self.words: list[bytes] = []
        self.numbers: list[int] = []
        self.place, self.length = place, length or len(words[0])
        self.lists: list[dict[bytes, list[int]]] = []
        if max(len(words), expected) > FEW:
            self.lists = [defaultdict(list) for _ in range(self.length - Q + 1)]
        for w in words:
            self.add(w)

    def add(self, word: bytes) -> None:
        i = len(self.words)
        self.words.append(word)
        self.numbers.append(int.from_bytes(word))
        for at, of in enumerate(self.lists):
            if at != self.place:
                of[word[at : at + Q]].append(i)

    def near(self, word: bytes) -> list[int]:
        """The posted words, as long as ``word`` or one longer, that are one edit from it."""
        numbers, x, longer = self.numbers, int.from_bytes(word), self.length - len(word)
        least = shared_at_least(self.length) - 1  # the key's gram is shared by all
        if not self.lists or least <= 0:
            return [i for i, y in enumerate(numbers) if _apart_by_one(x, y, longer)]
        lists = []
        for at in range(len(word) - Q + 1):
            gram = word[at : at + Q]
            for of in self.lists[at : at + longer + 1]:
                if gram in of:
                    lists.append(of[gram])
        if len(lists) < least:
            return []
        # the longest lists, one fewer than the bound, are not merged: what is in none of the others cannot reach it
        lists.sort(key=len)
        del lists[len(lists) - least + 1 :]
        found = lists[0] if len(lists) == 1 else [i for i, _ in groupby(heapq.merge(*lists))]
        return [i for i in found if _apart_by_one(x, numbers[i], longer)]


def _near(batches):
    """Near pairs of the rows of each (key, salt), which come together, posted words first; of two posted words the later one asks."""
    key, posted, counts, index = None, [], [], None
    out: list[list] = [[], [], [], []]

    def ask(word: bytes, n: int):
        for i in index.near(word):
            for column, value in zip(out, (word.decode("latin-1"), n, index.words[i].decode("latin-1"), counts[i])):
                column.append(value)

    def flush():
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.string(), pa.int64()))], ["a", "na", "b", "nb"])
        for column in out:
            column.clear()
        return batch

    def begin(asked: bool = True):
        nonlocal index
        if index is None and len(posted) > 1 - asked:
            index = Index([], key[2], key[1], len(posted))
            for w, n in zip(posted, counts):
                ask(w, n)
                index.add(w)

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for gram, length, place, salt, asks, word, n in zip(*columns):
            if (gram, length, place, salt) != key:
                begin(False)
                key, posted, counts, index = (gram, length, place, salt), [], [], None
            if not asks:
                posted.append(word.encode("latin-1"))
                counts.append(n)
            elif posted:
                begin()
                ask(word.encode("latin-1"), n)
        if len(out[0]) > 10_000:
            yield flush()
    begin(False)
    yield flush()


def near_words(words: DataFrame, scratch: Scratch, posted_most: int = POSTED) -> DataFrame:
    """(word, other, other_n): every pair of words one edit apart, in both directions."""
    shared = words.sparkSession.sparkContext.broadcast(gram_ranks(words))
    posted = scratch.write(words.select("word", "n").mapInArrow(_posted(shared), POSTINGS), "posted")
    rows = dealt(posted, posted_most).repartition(posted.count() // ROWS + 1, *KEY, "salt").sortWithinPartitions(*KEY, "salt", "asks", "word")
    found = rows.mapInArrow(lean(_near), "a string, na long, b string, nb long")
    one, two = F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("other_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("na").alias("other_n"))
    return found.select(F.explode(F.array(one, two)).alias("x")).select("x.*").distinct()


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of all words with a form, by doubling: each step follows twice as many forms."""
    at = scratch.write(forms.select("word", F.col("form").alias("root")), "roots0")
    step = 0
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        step += 1
        new = scratch.write(at.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), f"roots{step}")
        scratch.drop(f"roots{step - 2}")
        at = new.select("word", "root")
        if new.where("moved").isEmpty():
            return at


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.write(word_counts(docs, id_col, text_col), "words")
    near = near_words(words, scratch).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("best"))
    best_n = -F.col("best.less")
    formed = best_n >= times * F.col("n")
    told = words.join(near, "word", "left").select("word", F.when(formed, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, best_n).alias("form_n"))
    told = scratch.write(told, "told")
    found = roots(told.where(F.col("form").isNotNull()), scratch)
    return told.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


#: The same by SQL. The checksum runs over bytes with the table of its polynomial; near words of equal
#: length share a pattern with one letter blanked, others one is the other without a letter.
OP13_SQL = r"""WITH RECURSIVE bits AS (SELECT i, i AS v, 0 AS k FROM (SELECT unnest(range(256)) AS i) UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS MATERIALIZED (SELECT id, w, count(*) AS c FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS w FROM documents) GROUP BY id, w),
sums AS (SELECT id, w, c, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(id || ':' || w, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [(192 + (ord(x) >> 6))::BIGINT, (128 + (ord(x) & 63))::BIGINT] END))), lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)]))) AS h FROM runs, crc WHERE length(w) >= 6),
kept AS (SELECT CASE WHEN h % 199 = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, c FROM sums),
v AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM kept WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
blanked AS MATERIALIZED (SELECT word, n, i, word[:i - 1] || '?' || word[i + 1:] AS p, word[:i - 1] || word[i + 1:] AS d FROM places),
pairs AS (SELECT a.word, b.word AS other, b.n AS other_n FROM blanked a JOIN blanked b ON a.p = b.p AND a.word <> b.word UNION SELECT a.word, v.word, v.n FROM blanked a JOIN v ON a.d = v.word UNION SELECT v.word, a.word, a.n FROM blanked a JOIN v ON a.d = v.word),
near AS (SELECT word, count(*) AS n_near, max(other_n) AS most FROM pairs GROUP BY word),
best AS (SELECT p.word, min(other) AS other FROM pairs p JOIN near ON near.word = p.word AND p.other_n = near.most GROUP BY p.word),
told AS MATERIALIZED (SELECT v.word, CASE WHEN most >= 5 * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * n THEN most END AS form_n FROM v LEFT JOIN near ON near.word = v.word LEFT JOIN best ON best.word = v.word),
chain AS (SELECT word, word AS root, form FROM told UNION ALL SELECT chain.word, chain.form, told.form FROM chain JOIN told ON told.word = chain.form)
SELECT told.word, told.form, chain.root, told.n, CAST(told.n_near AS BIGINT) AS n_near, told.form_n FROM told JOIN chain ON chain.word = told.word AND chain.form IS NULL"""
