"""Pairs of whole texts against the k-grams themselves, and lines against a plain count."""

import random
import re

import pytest

from tidewrack.operators import matching, tokens

COLUMNS = ["doc_a", "start_a", "doc_b", "start_b", "n_tokens"]


def odd_texts(seed: int) -> list[str | None]:
    """Few words, so that much is common: copies, texts that repeat themselves, marks, numbers, other scripts, nulls."""
    r = random.Random(seed)
    words = ["a", "B", "7", "12", "_x1", "é", "漢字", "𝔸", "x²", ";", "(", " ", "\x0b", "\n", "١٢", "é"]
    texts: list[str | None] = [" ".join(r.choice(words[: r.choice((3, 8, 16))]) for _ in range(r.randrange(0, 60))) for _ in range(25)]
    texts += [texts[i] for i in (1, 1, 2, 3, 3, 3, 3, 3)] + ["a b " * 30, "a " * 50, "a b " * 30, None, None, "", "\n\n"]
    for _ in range(20):  # parts of one and of the other
        x, y = (r.choice(texts[:25]).split(" ") for _ in "ab")
        texts.append(" ".join(x[r.randrange(9) :] + y[: r.randrange(40)]))
    return texts


@pytest.mark.parametrize("seed, k, cap", [(1, 5, 50), (2, 5, 4), (3, 8, 3), (4, 3, 7), (5, 1, 20)])
def test_pairs_of_texts_as_of_kgrams(spark, seed, k, cap):
    docs = spark.createDataFrame([(100 - i, t) for i, t in enumerate(odd_texts(seed))], "doc_id long, text string")
    want = sorted(map(tuple, matching.clone_pairs(tokens.kgrams(docs, k), k, cap).select(*COLUMNS).collect()))
    got = sorted(map(tuple, matching.text_clone_pairs(docs, k, cap).select(*COLUMNS).collect()))
    assert got == want and want


def test_pairs_where_doc_ids_repeat_or_miss(spark):
    text = "one two three four five six"
    docs = spark.createDataFrame([(1, text), (1, text + " end"), (None, text), (2, text)], "doc_id long, text string")
    want = sorted(map(tuple, matching.clone_pairs(tokens.kgrams(docs, 4), 4).select(*COLUMNS).collect()))
    assert sorted(map(tuple, matching.text_clone_pairs(docs, 4).select(*COLUMNS).collect())) == want


def test_rows_are_kept_only_of_what_is_common(spark):
    """A text without anything in common with others gives no row, a copied one a single piece."""
    r = random.Random(9)
    texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(3000)) for _ in range(4)]
    rows = [(i, t, 1 + (i == 2)) for i, t in enumerate(texts)]
    got = [tuple(x) for x in matching._pieces(spark.createDataFrame(rows, "id long, text string, w long"), 40).select("id", "start", "len", "size").collect()]
    assert got == [(2, 0, 3000 - 39, 2)]


def test_texts_without_copies_are_not_moved(spark, monkeypatch):
    """They were all dealt out anew and written once more, which took more disk than the pairs."""
    held = []
    written = matching.written
    monkeypatch.setattr(matching, "written", lambda df, path: held.append(written(df, path)) or held[-1].persist())
    r = random.Random(11)
    texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(60)) for _ in range(300)]
    texts += [texts[5], " ".join(texts[9].split()[:50] + texts[8].split()[:50])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs = sorted(tuple(x) for x in matching.text_clone_pairs(docs, 40).select(*COLUMNS).collect())
    assert pairs == [(5, 0, 300, 0, 60), (8, 0, 301, 50, 50), (9, 0, 301, 0, 50)]
    (kept,) = held
    assert kept.count() < 10 and [5, 300] in [sorted(x.docs) for x in kept.collect()]


def test_line_starts_as_plain_python(spark):
    texts = odd_texts(6)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lexeme = re.compile(r"(?:[^\W]|[²])+|[^ \t\n\x0b\f\r\w]")
    want = []
    for i, t in enumerate(texts):
        first = 0
        for j, line in enumerate((t or "").split("\n")):
            n = len(lexeme.findall(line))
            want.append((i, j, first, n))
            first += n
    assert sorted(map(tuple, tokens.line_starts(docs).collect())) == want


def test_overlaps_go_in_greedy_order(spark):
    from tidewrack.operators.clusters import without_overlaps

    r = random.Random(5)
    rows = list({(r.randrange(40), f"d{r.randrange(3)}", r.randrange(60), r.randrange(1, 20)) for _ in range(1500)} | {(99, "d0", 0, 5), (99, "d0", 2, 4)})
    kept = set()
    for group in {x[:2] for x in rows}:
        mine = []
        for x in sorted((x for x in rows if x[:2] == group), key=lambda x: (-x[3], x[2])):
            if all(x[2] >= y[2] + y[3] or y[2] >= x[2] + x[3] for y in mine):
                mine.append(x)
        kept |= set(mine)
    kept = {x for x in kept if sum(x[0] == y[0] for y in kept) > 1}
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # groups go over the ends of batches
    try:
        got = without_overlaps(spark.createDataFrame(rows, "cluster long, doc_id string, start int, n_tokens int"))
        assert {tuple(x) for x in got.collect()} == kept
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)


def test_a_group_of_spans_costs_no_python_call(spark, monkeypatch):
    """A million groups of a span each took longer than the rest of the query."""
    from tidewrack.operators import clusters

    plans = []
    monkeypatch.setattr(clusters, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df, raising=False)
    found = clusters.without_overlaps(spark.createDataFrame([(1, 1, 0, 5), (1, 2, 0, 5)], "cluster long, doc_id long, start int, n_tokens int"))
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString() + "".join(plans)
    assert found.count() == 2


@pytest.mark.parametrize("seed, k", [(1, 5), (3, 8)])
def test_spans_of_texts_as_of_all_kgrams(spark, seed, k):
    """No k-gram is too frequent, copies of a text aren't paired, and the spans are those of all pairs."""
    from tidewrack.operators import clusters

    docs = spark.createDataFrame([(100 - i, t) for i, t in enumerate(odd_texts(seed))], "doc_id long, text string")
    every = matching.maximal_pairs(matching.clone_pairs(tokens.kgrams(docs, k), k, None).localCheckpoint())
    want = {tuple(x) for x in clusters.without_overlaps(clusters.spans(every.localCheckpoint())).select("doc_id", "start", "n_tokens").collect()}
    got = [tuple(x) for x in clusters.whole_without_overlaps(docs, k).collect()]
    assert set(got) == want and len(got) == len(want)


def test_a_passage_of_more_than_fifty_texts_is_a_cluster(spark, tmp_path):
    """A cap of 50 dropped it; the SQL says the same."""
    import duckdb

    from tidewrack import catalogue

    shared = " ".join(f"same{i}" for i in range(45))
    rows = [(i, f"left{i} {shared} right{i}") for i in range(60)] + [(60 + i, f"twice {shared}") for i in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, catalogue.QUERIES["span_clusters_without_overlaps"](spark, str(tmp_path)).collect()))
    assert got == sorted([(i, 1, 45) for i in range(63)] + [(60 + i, 0, 46) for i in range(3)])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(catalogue.ORACLES["span_clusters_without_overlaps"]).fetchall())
