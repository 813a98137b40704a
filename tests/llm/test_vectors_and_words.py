"""Subspace join, sort-means and spelling variants against brute force and SQL, on planted and on hostile rows."""

import collections
import hashlib
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from vaultgrid.llm import lm_score, sort_means, spelling, subspace_join
from vaultgrid.llm.common import Scratch

SF = "/root/testdata/sf0.001"
VECTORS = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32()), ("n_links", pa.int32()), ("node", pa.string()), ("cluster", pa.string()), ("x", pa.string())])


def vector_folder(tmp_path, rows):
    ids, vectors, labels = zip(*rows) if rows else ([], [], [])
    n = len(ids)
    pq.write_table(pa.table([pa.array(ids, pa.int64()), pa.array(vectors, pa.list_(pa.float32())), pa.array(labels, pa.int32()), pa.array([1] * n, pa.int32()), *[pa.array(["s"] * n)] * 3], schema=VECTORS), tmp_path / "embeddings.parquet")
    return str(tmp_path)


def families(seed, labels=3, width=64, sizes=(1, 2, 7, 30), spread=0.3):
    """Vectors round centres, near enough that some of a family link and some do not."""
    rng = np.random.default_rng(seed)
    out = []
    for label in range(labels):
        for size in sizes:
            centre = rng.normal(size=width) / np.sqrt(width)
            out += [(len(out), (centre + spread * rng.random() * rng.normal(size=width) / np.sqrt(width)).tolist(), label) for _ in range(size)]
    return [(i, v, label) for i, (_, v, label) in enumerate(out)]


HOSTILE = [
    (0, [1.0, 0.0], 1), (1, [1.0, 0.01], 1), (2, [1.0, 0.0], 2), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [float("nan"), 1.0], 1), (7, [1.0, None], 1), (8, [2.0, 0.0], 1), (9, [2.0, 0.0], 1),
    (9, [2.0, 0.0], 1), (None, [2.0, 0.0], 1), (10, [1.0, 0.0, 0.0], 1), (11, [1e-30, 0.0], 1), (12, [1e30, 1e29], 1), (13, [float("inf"), 1.0], 1), (14, [], 1), (15, [-1.0, 0.0], 1), (None, [0.0, 1.0], 1), (None, None, None), (16, [0.0], 1),
    (17, [3.0], 5), (18, [7.0], 5), (19, [-1.0], 5),
]


def brute_links(rows, cosine=0.93):
    def good(v):
        return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)

    rows = [(i, None if not good(v) else np.array(v, np.float32).astype(float), label) for i, v, label in rows]
    n, near = len(rows), collections.defaultdict(set)
    for a in range(n):
        for b in range(a):
            (_, x, p), (_, y, q) = rows[a], rows[b]
            if x is not None and y is not None and p is not None and p == q and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= cosine:
                near[a].add(b)
                near[b].add(a)
    label = list(range(n))
    for a in range(n):
        todo, part = [a], {a}
        while todo:
            for b in near[todo.pop()] - part:
                part.add(b)
                todo.append(b)
        label[a] = min((rows[b][0] for b in part if rows[b][0] is not None), default=None)
    return sorted(((str(rows[a][0]), len(near[a]), str(label[a]), rows[a][0] == label[a]) for a in range(n)))


def links_of(df):
    return sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in df.collect())


@pytest.mark.parametrize("blocks, cell", [(8, 2048), (8, 16), (4, 5), (1, 3), (64, 16)])
def test_links_against_brute_force(spark, tmp_path, blocks, cell):
    """Whole labels in a task, cells cut by components, and cells dealt out in shares give the same."""
    rows = families(blocks) + [(900 + i, v, label) for i, (_, v, label) in enumerate(families(blocks, 2)[20:30] * 2)]
    df = spark.read.parquet(vector_folder(tmp_path, rows) + "/embeddings.parquet")
    got = links_of(subspace_join.components(df, blocks=blocks, cell=cell).withColumnRenamed("id", "vec_id"))
    want = brute_links(rows)
    assert got == want
    assert len({x[1] for x in want}) > 5


@pytest.mark.parametrize("rows", [HOSTILE, HOSTILE + families(3, 1), families(5, 2, 5), families(6, 2, 1), []])
def test_hostile_vectors(spark, tmp_path, rows):
    folder = vector_folder(tmp_path, rows)
    got = links_of(subspace_join.op11_subspace_join(spark, folder))
    assert got == brute_links(rows)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet'")
    assert sorted((str(i), n, str(c), k) for i, n, c, k in con.execute("SELECT vec_id, n_links, component_id, kept FROM (" + subspace_join.OP11_SQL + ")").fetchall()) == got


def test_a_hot_cell_sends_no_row_a_pair(spark, tmp_path):
    """A family of 900 near copies has 400,000 links; tasks tell a few rows a vector."""
    rows = [(i, v, 0) for i, (_, v, _) in enumerate(families(9, 1, 64, (900,), 0.05))]
    df = spark.read.parquet(vector_folder(tmp_path, rows) + "/embeddings.parquet")
    scratch = Scratch(spark, "t")
    classes = df.selectExpr("vec_id AS node", "label", "embedding AS vec", "1L AS copies")
    assert subspace_join.links(scratch.write(classes, "c"), scratch, 0.93, cell=100).count() < 900 * 8 * 20
    got = subspace_join.components(df, cell=100).collect()
    assert {r["n_links"] for r in got} == {899} and {r["component_id"] for r in got} == {0}


def test_exact_cosine_at_the_limit(spark, tmp_path):
    """93, 36, 6, 3, 3.162... squares to 10000 only in whole numbers: (93, 36, 7, 2, 1, 1) has length 100."""
    assert 93**2 + 36**2 + 7**2 + 2 + 2**2 == 10000
    rows = [(1, [100, 0, 0, 0, 0, 0], 0), (2, [93, 36, 7, 1, 1, 2], 0), (3, [92, 36, 7, 1, 1, 2], 0)]
    got = links_of(subspace_join.op11_subspace_join(spark, vector_folder(tmp_path, rows)))
    assert got == brute_links(rows)
    assert ("1", 1, "1", True) in got


def test_budgets_hold_the_whole_distance():
    """Rotations keep distances, budgets add up, and every pair within the whole distance is within budget in a block whose cells meet."""
    rng = np.random.default_rng(1)
    x = subspace_join.unit(rng.normal(size=(400, 24)) * np.linspace(3, 0.1, 24))
    x = subspace_join.unit(np.concatenate([x, x + 0.08 * rng.normal(size=x.shape)]))
    blocks = subspace_join.Blocks(24, x, 0.14, 6)
    y = blocks.turned(x)
    assert np.allclose(y @ y.T, x @ x.T) and abs(sum(blocks.budget) - 0.14) < 1e-6 and sorted(i for p in blocks.parts for i in p) == list(range(24))
    a, b = np.nonzero(np.triu(np.square(x[:, None] - x[None]).sum(2) <= 0.14, 1))
    assert len(a) > 50
    first = blocks.first(y[a], y[b])
    for k in range(6):
        cells = collections.defaultdict(lambda: (set(), set()))
        for rows, cell, home in blocks.cells(y, k, 2):
            for r, c, h in zip(rows.tolist(), map(tuple, cell.tolist()), home.tolist()):
                cells[c][0].add(r)
                if h:
                    cells[c][1].add(r)
        assert sorted(r for _, homes in cells.values() for r in homes) == list(range(len(x)))
        for i, j in zip(a[first == k].tolist(), b[first == k].tolist()):
            assert sum(i in asks and j in homes for asks, homes in cells.values()) == 1


def brute_means(rows, k=8, rounds=10):
    kept = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v, _ in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    kept = [(i, [min(max(x, -(1 << 27)), 1 << 27) for x in v]) for i, v in kept]
    centroids = [v for _, v in sorted(((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept))[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    for step in range(rounds + 1):
        at = [min((far(v, c), n) for n, c in enumerate(centroids)) for _, v in kept]
        if step < rounds:
            for n in range(len(centroids)):
                own = [v for (_, v), (_, m) in zip(kept, at) if m == n]
                if own:
                    centroids[n] = [sum(x) // len(own) for x in zip(*own)]
    total = collections.Counter()
    for d, n in at:
        total[n] += d
    return sorted((str(i), n, d, total[n], sum(total.values()), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(kept, at))


MEANS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
ODD = [(None, [0.5] * 64, 1), (None, [0.5] * 64, 1), (700, [0.5] * 64, 1), (700, [-0.5] * 64, None), (701, [1.0] * 63, 1), (702, None, 1), (703, [float("inf")] + [0.0] * 63, 1), (704, [None] + [0.0] * 63, 1), (705, [0.0] * 64, 1), (706, [-1e-9] * 64, 1), (707, [float("nan")] * 64, 1)]


@pytest.mark.parametrize("rows", [families(1, 2, sizes=(40, 3, 60)), families(2, 1, sizes=(20,), spread=3) + ODD, ODD, ODD[:1], [(i, [float(i // 4 % 2)] * 64, 0) for i in range(40)], []])
def test_means_against_brute_force_and_sql(spark, tmp_path, rows):
    folder = vector_folder(tmp_path, rows)
    got = sorted((str(r["vec_id"]), *(r[c] for c in MEANS[1:])) for r in sort_means.op12_sort_means(spark, folder).collect())
    assert got == brute_means(rows)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet'")
    assert sorted((str(r[0]), *r[1:]) for r in con.execute(f"SELECT {', '.join(MEANS)} FROM ({sort_means.OP12_SQL})").fetchall()) == got


def test_huge_components_saturate(spark, tmp_path):
    rows = [(1, [3e38] + [0.0] * 63, 0), (2, [-3e38] * 64, 0), (3, [1.0] * 64, 0)]
    got = sorted((str(r["vec_id"]), *(r[c] for c in MEANS[1:])) for r in sort_means.op12_sort_means(spark, vector_folder(tmp_path, rows)).collect())
    assert got == brute_means(rows)


def test_scan_stops_only_beyond_twice_the_distance():
    """The scan gives what a full one gives, ties included, from any centroid it begins at."""
    rng = np.random.default_rng(0)
    x, centroids = rng.integers(-3, 4, (500, 3)), rng.integers(-3, 4, (12, 3))
    full = np.square(x[:, None] - centroids).sum(2)
    for before in range(12):
        cluster, distance = sort_means.nearest(x, np.full(500, before), centroids)
        assert (cluster == full.argmin(1)).all() and (distance == full.min(1)).all()


def document_folder(tmp_path, rows):
    ids, texts = zip(*rows) if rows else ([], [])
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "word": pa.array(["x"] * len(ids), pa.string()), "n": pa.array(["y"] * len(ids), pa.string())}), tmp_path / "documents.parquet")
    return str(tmp_path)


def brute_variants(rows):
    import re

    count = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    v = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}
    spread = collections.defaultdict(set)
    for w in v:
        for k in range(len(w)):
            spread[w[:k] + "\0" + w[k + 1 :]].add(w)
    near = collections.defaultdict(set)
    for w in v:
        for k in range(len(w)):
            near[w] |= spread[w[:k] + "\0" + w[k + 1 :]] - {w}
            shorter = w[:k] + w[k + 1 :]
            if shorter in v:
                near[w].add(shorter)
                near[shorter].add(w)
    form = {}
    for w in near:
        if near[w]:
            best = min(near[w], key=lambda o: (-v[o], o))
            if v[best] >= 5 * v[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, str(form.get(w)), root(w), n, len(near[w]), str(v.get(form.get(w)))) for w, n in v.items())


def variants_of(rows):
    return sorted((r["word"], str(r["form"]), r["root"], r["n"], r["n_near"], str(r["form_n"])) for r in rows)


def chain_rows():
    words = {"normal": 700, "normql": 130, "norrmql": 20, "noormql": 6, "normall": 30, "orderly": 50, "orderl": 10, "oorderly": 10, "rderly": 9, "étoilé": 60, "étoile": 12, "ÉTOILÉ": 12, "naïvité": 40, "naivité": 8, "aaaaaaaa": 100, "aaaaaaaaa": 20, "aaaaaaa": 20, "tiesxx": 5, "tiesxa": 25, "tiesxb": 25, "abcdef": 25, "abcde": 200, "xbcdef": 5, "日本語étrange": 9}
    texts = [f"{w}, {w.upper() if w.isascii() and k % 3 == 0 else w}" for w, n in words.items() for k in range(n // 2)]
    return [(i, t) for i, t in enumerate(texts)]


WORDS = [(None, "Hidden hidden HIDDEN hidden hidden"), (None, None), (3, ""), (3, "hiddens " * 6 + "×÷×÷×÷ " * 7), (3, "hiddens " * 6), (4, "x" * 30_000 + " " + ("y" * 3000 + " ") * 6), (5, ("y" * 2999 + "z ") * 5), (6, "don't_stop99now " * 9)]


@pytest.mark.parametrize("rows", [chain_rows(), WORDS, chain_rows() + WORDS * 3, WORDS[1:3], []])
def test_variants_against_brute_force_and_sql(spark, tmp_path, rows):
    folder = document_folder(tmp_path, rows)
    got = variants_of(spelling.op13_spelling_variants(spark, folder).collect())
    assert got == brute_variants(rows)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    assert sorted((w, str(f), r, n, k, str(fn)) for w, f, r, n, k, fn in con.execute(f"SELECT word, form, root, n, n_near, form_n FROM ({spelling.OP13_SQL})").fetchall()) == got


def test_variants_of_the_table(spark):
    rows = duckdb.connect().execute("select doc_id, text from '/root/testdata/sf0.01/documents.parquet'").fetchall()
    got = variants_of(spelling.op13_spelling_variants(spark, "/root/testdata/sf0.01").collect())
    assert got == brute_variants(rows)
    assert sum(form != "None" for _, form, *_ in got) > 20


@pytest.mark.parametrize("most", [1, 3, 4096])
def test_postings_in_shares_lose_nothing(spark, most):
    """Words that all share their rarest gram, posted whole and in shares."""
    rng = np.random.default_rng(0)
    words = sorted({"zzz" + "".join("abcdefg"[i] for i in rng.integers(0, 3, n)) for n in (4, 5) for _ in range(150)})
    df = spark.createDataFrame([(w, k + 5) for k, w in enumerate(words)], "word string, n long")
    scratch = Scratch(spark, "t")
    got = sorted((r["word"], r["other"], r["other_n"]) for r in spelling.near_words(scratch.write(df, "w"), scratch, most).collect())
    enc = [w.encode() for w in words]
    assert got == sorted((a, b, j + 5) for i, a in enumerate(words) for j, b in enumerate(words) if i != j and spelling.one_edit(enc[i], enc[j]))


def test_one_edit():
    import itertools

    words = ["".join(w).encode() for n in range(5) for w in itertools.product("ab", repeat=n)]
    for a in words:
        near = {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in (b"a", b"b")} | {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + c + a[i + 1 :] for i in range(len(a)) for c in (b"a", b"b")}
        assert {b for b in words if spelling.one_edit(a, b)} == {b for b in near if b != a and len(b) < 5}


def test_rows_of_a_training_step_are_sorted_once():
    rows = np.random.default_rng(0).integers(0, lm_score.CLASSES, 1152)
    order, at, first = lm_score._grouped(rows)
    want, begins = np.unique(rows[np.argsort(rows, kind="stable")], return_index=True)
    assert (order == np.argsort(rows, kind="stable")).all() and (at == want).all() and (first == begins).all()


def test_posted_words_meet_once():
    """Each pair of a key's posted words is told once, by the later word, and the merge without the longest lists loses none."""
    rng = np.random.default_rng(3)
    for length in (6, 7, 8, 10, 13):
        words = sorted({b"abc" + bytes(rng.choice(list(b"abd\xe9"), length - 3).tolist()) for _ in range(150)} | {b"abc" + b"a" * k + b"z" + b"a" * (length - 4 - k) for k in range(length - 3)})
        n = len(words)
        columns = [[7] * n, [length] * n, [0] * n, [0] * n, [False] * n, [w.decode("latin-1") for w in words], list(range(n))]
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["gram", "length", "place", "salt", "asks", "word", "n"])
        got = [x for b in spelling._near(iter([batch])) for x in zip(b["na"].to_pylist(), b["nb"].to_pylist())]
        assert sorted(got) == [(i, j) for i in range(n) for j in range(i) if spelling.one_edit(words[i], words[j])]
        shorter = [w[:k] + w[k + 1 :] for w in words[:20] for k in range(3, length)]
        index = spelling.Index(words, 0)
        assert all(sorted(index.near(w)) == [i for i, x in enumerate(words) if spelling.one_edit(w, x)] for w in shorter)


def test_classes_are_worked_out_once_for_two_last_bytes():
    words = [bytes([i % 251, j % 253, i, j])[: 1 + (i + j) % 4] for i in range(60) for j in range(60)] + [b""]
    assert [lm_score.BUCKET_OF[w[-2:]] for w in words] == [lm_score.bucket(w) for w in words]
    assert len(lm_score.BUCKET_OF) <= 1 + (1 << 8) + (1 << 16)
