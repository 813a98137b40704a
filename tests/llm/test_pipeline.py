"""The pipeline's stages on the smallest tables, each held against what it promises."""

import corpus_pipeline as p
from vaultgrid.llm.common import Scratch, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs, scratch, seen = table(spark, SF, "documents"), Scratch(spark, "t"), []
    for name, stage in p.STAGES:
        docs = scratch.write(stage(spark, docs, SF), str(len(seen)))
        if len(seen) < 4:
            assert docs.columns == p.COLUMNS, name
        seen.append(docs)
    quality, copies, passages, mixed, packed = seen
    n = [x.count() for x in seen]
    assert 0 < n[1] <= n[0] < 200 and n[2] <= n[1]
    assert copies.select("doc_id").distinct().count() == n[1]
    words = lambda d: d.selectExpr("sum(regexp_count(text, '[^ \\t-\\r]+')) AS w").first()["w"]
    assert words(passages) <= words(copies)
    assert abs(words(mixed) - 1.5 * words(passages)) < 0.02 * words(passages)
    assert packed.where("length > 1024 OR offset + length > 1024").count() == 0
    assert packed.where("start = 0").count() == n[3]


def test_run(spark):
    assert p.run(spark, SF).count() > 0


def test_near_copies_at_five_words_and_eighty_percent(spark):
    """A text with words appended goes at 82 of 100 shingles of five words, and stays at 79."""
    text = lambda c, n: " ".join(f"c{c}w{j}" for j in range(n + 4))
    rows = [(1, text(0, 82)), (2, text(0, 100)), (3, text(1, 79)), (4, text(1, 100))]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in p.near_copies(spark, docs, SF).collect()) == [1, 3, 4]


PASSAGE = " ".join(f"w{i}" for i in range(80))
ODD = [
    (1, f"Start {PASSAGE} end", "en", "b", 5), (2, f"other words {PASSAGE}", None, "a", None), (3, None, "en", None, 0), (4, "", None, "a", 0), (5, "one two", "en", "b", 7), (6, "one two", "en", "b", 7),
    (7, "x " * 60000, "en", "a", 120000), (8, f"Start {PASSAGE} end", "en", "b", 5), (8, f"Start {PASSAGE} end", "en", "b", 5), (None, f"null id {PASSAGE}", "en", "a", 3), (9, " \t\n", "en", "a", 3), (9, " \t\n", "en", "a", 3),
]
KIND = "doc_id long, text string, lang string, source string, n_chars long, score int, size string, __id int, copies int, label string, starts int, cls int"


def odd(spark, rows=ODD):
    return spark.createDataFrame([(*r, 1, "s", 2, 3, "l", 4, 5) for r in rows], KIND)


def ids(df):
    return sorted((str(r["doc_id"]) for r in df.collect()))


def test_quality_on_odd_rows(spark):
    got = p.quality(spark, odd(spark), SF)
    assert got.columns == p.COLUMNS
    both = [r for r in ids(got) if r == "8"]
    assert len(both) in (0, 2) and got.count() <= len(ODD)


def test_near_copies_on_odd_rows(spark):
    got = p.near_copies(spark, odd(spark), SF)
    assert got.columns == p.COLUMNS
    assert ids(got) == sorted(["1", "2", "3", "4", "5", "7", "None", "9"]) or ids(got) == sorted(["1", "3", "4", "5", "7", "9"])


def test_passages_on_odd_rows(spark):
    got = {(r["doc_id"], r["text"]) for r in p.passages(spark, odd(spark), SF).collect()}
    assert (1, f"Start {PASSAGE} end") in got and (2, "other words") in got and (None, f"null id {PASSAGE}") in got
    assert (3, None) in got and (4, "") in got and (9, " \t\n") in got and (5, "one two") in got
    assert not any(i == 8 for i, _ in got)  # all of its words are the first document's
    assert [len(t) for i, t in got if i == 7] == [120000]


def test_mixing_on_odd_rows(spark):
    got = p.mixed(spark, odd(spark), SF)
    assert got.columns == p.COLUMNS
    assert {r["text"] for r in got.collect()} <= {r[1] for r in ODD} and got.count() > 0


def test_packing_on_odd_rows(spark):
    got = p.packed(spark, odd(spark), SF).collect()
    assert sum(r["start"] == 0 for r in got) == len(ODD)
    assert max(r["offset"] + r["length"] for r in got) <= 1024


def test_stages_on_empty_tables(spark):
    for name, stage in p.STAGES:
        assert stage(spark, odd(spark, []), SF).count() == 0, name
