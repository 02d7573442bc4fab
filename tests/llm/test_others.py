"""Pages, shards, neighbours, the pipeline and the registered queries."""

import threading

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from tests.llm.conftest import DOCS, ODD
from tidewrack.llm import html, neighbours, queries, shards
from tidewrack.plans.lineage import work_dir

# op4


def test_leaf_blocks():
    page = "<body><p>A &amp; <b>b</b>c<br>d<p>e<ul><li>x<li>y</ul><script>var t='</p>';</script><!-- <p>no</p> --><div>f<p>g</div>h"
    assert [b.text for b in html.leaf_blocks(page)] == ["A & bc d", "e", "x", "y", "f", "g", "h"]
    assert html.leaf_blocks(None) == [] and html.leaf_blocks("") == [] and html.leaf_blocks("<p> \n </p>") == []
    assert [b.text for b in html.leaf_blocks("plain &lt;text&gt; < 3")] == ["plain <text> < 3"]
    assert html.leaf_blocks("<script>never closed")  == []


def texts(page):
    return [b.text for b in html.leaf_blocks(page)]


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article><p>a<svg/>b</p>c</article>", ["ab", "c"]),
        ("<p>a<svg><path d='x'/><title>t</title></svg>b", ["a", "b"]),
        ("<svg><path><p>text", ["text"]),
        ("<div><object>unseen<p>unseen</div><p>seen</p>", ["seen"]),
        ("<div><audio>x</div>a<div><canvas>x</div>b<div><noscript>x</div>c<div><template>x</div>d", ["a", "b", "c", "d"]),
        ("<iframe src=x><p>a</p>", ["a"]),
        ("<iframe src=x/>gone</iframe><p>a</p>", ["a"]),
        ("<p title=it's>ok</p><p>don't</p>", ["ok", "don't"]),
        ('<a href="x>text</a> more', ["text more"]),
        ("<p>1 < 2 <b>x</b></p>a</ p>b", ["1 < 2 x", "a</ p>b"]),
        ("<p>a</p><b x", ["a", "<b x"]),
        ("<p>a<!-- b", ["a"]),
        ("<p>a</i></b></p></div>b", ["a", "b"]),
    ],
)
def test_malformed_pages(page, want):
    assert texts(page) == want


@pytest.mark.parametrize("part", ["<b x", "<", '<a href="', "<div>t", "<b>", "</b>", "<p><b>x<br>", "<iframe>", "<!--", "<b =\">", "<svg>", "<i><div>", "<td>x"])
def test_long_pages_take_linear_time(part):
    import time

    took = []
    for n in (200_000, 800_000):
        page = "<p>start</p>" + part * (n // len(part))
        began = time.process_time()
        assert texts(page)[:1] == ["start"]
        took.append(time.process_time() - began)
    assert took[1] < 0.3 + 8 * took[0]


def test_pages_of_other_layouts():
    from tests.llm.other_pages import PAGES

    right = found = wanted = 0
    for page, want in PAGES:
        got = [t for t in html.main_text(page, html.model()).split("\n\n") if t]
        right, found, wanted = right + len(set(got) & set(want)), found + len(got), wanted + len(want)
    assert right >= 0.9 * found and right >= 0.95 * wanted


def plain_article(page):
    """The blocks of the table's article element, by patterns: its pages have nothing else in it."""
    import html as entities
    import re

    inner = re.sub("<!--.*?-->", "", re.search("<article[^>]*>(.*?)</article>", page, re.S)[1], flags=re.S)
    parts = re.split(r"</?(?:p|h1|h2|h3|ul|li|div|blockquote|pre)\b[^>]*>", re.sub(r"<br\s*/?>", " ", inner))
    blocks = (" ".join(entities.unescape(re.sub("<[^>]+>", "", x)).split()) for x in parts)
    return "\n\n".join(b for b in blocks if b)


def test_chain_on_held_back_pages():
    pages = html.labelled_pages(150, seed=99)
    model, wrong, total = html.model(), 0, 0
    for p, y in pages:
        got = model.viterbi(html.block_features(html.leaf_blocks(p)))
        assert len(got) == len(y)
        wrong += sum(a != b for a, b in zip(got, y))
        total += len(y)
    assert wrong <= 0.01 * total


def test_viterbi_is_the_best_path():
    import itertools

    r = np.random.default_rng(0)
    m = html.ChainModel(r.standard_normal((html.DIMS, 2)), r.standard_normal((2, 2)), r.standard_normal(2))
    slots = [list(r.integers(0, html.DIMS, 3)) for _ in range(8)]

    def score(y):
        s = m.start[y[0]] + sum(m.emission[x, k].sum() for x, k in zip(slots, y))
        return s + sum(m.transition[a, b] for a, b in zip(y, y[1:]))

    assert m.viterbi(slots) == list(max(itertools.product((0, 1), repeat=8), key=score))


def test_extraction(spark):
    article = "<article><h1>Head</h1><p>First  paragraph of the\ntext &eacute;.</p><p>And the second one, which is longer than the first.</p></article>"
    page = f'<html><head><title>T</title></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/b">Blog</a></li></ul></nav><div class="cookie-notice"><p>We use cookies.</p></div>{article}<div class="comments"><h2>Comments</h2><p>I do not agree with this at all.</p></div><footer>&copy; site</footer></body></html>'
    rows = [(1, "u", page, 1), (1, "u", page, 1), (2, None, None, 2), (None, "v", "", 3), (4, "w", "<html><nav><a href='/'>x</a></nav></html>", 4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = html.extract(pages).collect()
    text = "Head\n\nFirst paragraph of the text é.\n\nAnd the second one, which is longer than the first."
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "", 0), (1, text, len(text)), (1, text, len(text)), (2, "", 0), (4, "", 0)]
    assert html.extract(pages.limit(0)).count() == 0


def test_pages_of_the_table(spark, sf):
    page = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op4_html_extraction(spark, sf).collect()
    assert len(got) == len(page)
    for r in got:
        assert r.text == plain_article(page[r.page_id]) and r.n_chars == len(r.text)


# op6


def test_shards_keep_all_rows(spark, odd, none):
    store = shards.ShardStore(spark, work_dir(spark, "store"), target_bytes=1 << 20, least_bytes=1 << 10)
    store.append(odd, rows_per_shard=2)
    first = store.manifest()
    assert first.version == 1 and sum(s.rows for s in first.shards) == len(ODD)
    m = store.compact()
    assert m.version > 1 and len(m.shards) < len(first.shards) and sum(s.rows for s in m.shards) == len(ODD)
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(store.read()) == key(odd) == key(store.read(1))
    assert store.vacuum() > 0 and key(store.read()) == key(odd)
    assert store.append(odd.limit(0)).version == m.version + 1
    with pytest.raises(ValueError):
        store.append(none)


def test_tiers_and_runs(spark):
    store = shards.ShardStore(spark, "/none", target_bytes=1000, least_bytes=10, fan_in=4)
    s = lambda i, n: shards.Shard(str(i), n, 1)
    assert [store.tier(n) for n in (1, 39, 40, 159, 160)] == [0, 0, 1, 1, 2]
    assert store.runs(tuple(s(i, 20) for i in range(3))) == []
    assert [len(r) for r in store.runs(tuple(s(i, 20) for i in range(5)))] == [5]
    assert [len(r) for r in store.runs(tuple(s(i, 400) for i in range(4)))] == [2, 2]
    assert store.runs(tuple(s(i, 600) for i in range(9))) == []  # over half of the target: final


def test_commits_are_atomic(spark):
    path = work_dir(spark, "store")
    a, b = shards.ShardStore(spark, path), shards.ShardStore(spark, path)
    base = a.manifest()
    a._commit(base, "", ())
    with pytest.raises(shards.Conflict):
        b._commit(base, "", ())
    assert a.manifest() == shards.Manifest(1, "", ())
    assert a.versions() == [1]
    docs = spark.createDataFrame([(1, "a", None, None, None)], DOCS)
    stores = [(shards.ShardStore(spark, path), docs) for _ in range(4)]
    shards.append_concurrently(stores)
    assert a.versions() == [1, 2, 3, 4, 5] and a.read().count() == 4
    assert threading.active_count() > 0


def test_vacuum_spares_writers(spark):
    path = work_dir(spark, "store")
    docs = spark.createDataFrame([(i, f"t{i}", None, None, None) for i in range(8)], DOCS).repartition(4)
    a, b = shards.ShardStore(spark, path), shards.ShardStore(spark, path)
    a.append(docs)
    folder, files = b._written(docs)  # written, not committed yet
    assert a.vacuum() == 0
    base = a.append(docs)
    with pytest.raises(shards.Conflict):
        b._commit(a.manifest(base.version - 1), base.schema, files, (folder,))
    b._commit(base, base.schema, base.shards + files, (folder,))
    assert a.vacuum() == 0 and a.read().count() == 24 and a._list("intent") == []
    # of a writer that is long gone: its files go, and it can't commit any more
    folder, files = b._written(docs)
    late = shards.ShardStore(spark, path, grace_seconds=-5)
    assert late.vacuum() == len(files) > 0
    with pytest.raises(Exception, match="intent"):
        b._commit(a.manifest(), base.schema, base.shards + files, (folder,))
    assert a.read().count() == 24


def test_compaction_beside_writers(spark, monkeypatch):
    path = work_dir(spark, "store")
    docs = spark.createDataFrame([(i, f"t{i}", None, None, None) for i in range(40)], DOCS).repartition(4)
    a, b = (shards.ShardStore(spark, path, target_bytes=1 << 20, least_bytes=1 << 10) for _ in range(2))
    a.append(docs)
    written = a._written

    def then_another(df):
        out = written(df)
        monkeypatch.setattr(a, "_written", written)
        b.append(docs)
        return out

    monkeypatch.setattr(a, "_written", then_another)
    a.compact()
    assert a.read().count() == 80 and len(a.manifest().shards) < 5
    few = shards.ShardStore(spark, path, target_rows=10)
    assert few.runs(tuple(shards.Shard(str(i), 10, 4) for i in range(6))) == [[shards.Shard(str(i), 10, 4) for i in p] for p in ((0, 1), (2, 3), (4, 5))]


def test_shard_rows(spark, odd, none):
    got = shards.shard_documents(odd, rows_per_shard=2).collect()
    assert len(got) == len(ODD) and {r.doc_id for r in got} == {r[0] for r in ODD}
    assert [r.n_chars for r in got if r.doc_id == 1] == [None]
    assert shards.shard_documents(none).count() == 0


# op7


def brute(rows, every, k):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, x in ok.items():
        if q % every == 0:
            out[q] = sorted((-float(sum(np.float64(a) * b for a, b in zip(x, y))), i) for i, y in ok.items() if i != q)[:k]
    return out


@pytest.mark.parametrize("kind", ["random", "lengths", "copies"])
def test_neighbours(spark, kind):
    r = np.random.default_rng(3)
    x = r.standard_normal((700, 16)).astype("f4").astype(float)
    if kind == "lengths":
        x *= r.uniform(0.2, 3, (700, 1))
    if kind == "copies":
        x[100:350] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1001, [0.0] * 16), (1020, [None] * 16), (1040, [float("nan")] + [1.0] * 15), (1060, [float("inf")] + [1.0] * 15), (None, x[5].tolist())]
    frame = spark.createDataFrame([(*v, 1, 2) for v in rows], "vec_id long, embedding array<double>, id int, node int")
    got = {}
    for g in neighbours.nearest_neighbours(frame).collect():
        got.setdefault(g.query_id, []).append((g.rank, -g.score, g.vec_id))
    want = brute(rows, 20, 20)
    assert set(got) == set(want)
    hits = 0
    for q, w in want.items():
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 21)) and [m[1:] for m in mine] == sorted(m[1:] for m in mine)
        hits += len({m[2] for m in mine} & {i for _, i in w})
    assert hits >= 0.95 * 20 * len(want)


def test_hot_blocks_and_hubs(spark, monkeypatch):
    """Two thirds of the vectors are near copies: blocks in windows over several chunks."""
    monkeypatch.setattr(neighbours, "CHUNK", 700)
    r = np.random.default_rng(5)
    x = r.standard_normal((1500, 12))
    x[500:] = x[0] + 0.05 * r.standard_normal((1000, 12))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    index = neighbours.NeighbourIndex(spark.createDataFrame(rows, "vec_id long, vec array<double>"), leaf=64, trees=6)
    got = index.search(spark.createDataFrame([r for r in rows if r[0] % 20 == 0], "query_id long, vec array<double>"), 20).collect()
    want = brute(rows, 20, 20)
    hits = sum(len({g.vec_id for g in got if g.query_id == q} & {i for _, i in w}) for q, w in want.items())
    assert len(got) == 20 * len(want) and hits >= 0.9 * len(got)


def test_drawn():
    r = np.random.default_rng(2)
    owner, member = r.integers(0, 5, 900), r.permutation(900)
    kept = neighbours._drawn(owner, member, 7, 24)
    assert np.bincount(owner[kept]).tolist() == [24] * 5
    part = neighbours._drawn(owner[:400], member[:400], 7, 24)
    both = np.concatenate([part, np.arange(400, 900)])
    assert set(both[neighbours._drawn(owner[both], member[both], 7, 24)]) == set(kept)  # in any number of steps


def test_few_rows_are_worked_on_together():
    import pyarrow as pa

    seen = []
    run = neighbours._keyed("k", lambda t: seen.append(t.num_rows) or [])
    list(run(pa.record_batch([pa.array(range(i, i + 1000))], ["k"]) for i in range(0, 30_000, 1000)))
    assert sum(seen) == 30_000 and max(seen) <= 6_000


def test_mixed_lengths(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.9, 0.1]), (40, [1.0, 2.0, 3.0]), (2, [9.0]), (60, [7.0])]
    got = neighbours.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(0, 1, 20), (0, 2, 1), (20, 1, 0), (20, 2, 1)]


def test_few_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert neighbours.nearest_neighbours(spark.createDataFrame([], schema)).count() == 0
    one = neighbours.nearest_neighbours(spark.createDataFrame([(0, [1.0, 2.0])], schema))
    assert one.count() == 0
    three = neighbours.nearest_neighbours(spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [1.0, 2.0])], schema)).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in three) == [(1, 2, 5.0), (2, 1, 4.0)]


# the pipeline


def test_pipeline_stages(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "secret scans", "byte-level BPE"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    at, seen = docs, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = work_dir(spark, "stage")
        stage(spark, at, sf).write.parquet(path)
        at = spark.read.parquet(path)
        assert at.columns == docs.columns
        n = at.count()
        assert 0 < n <= seen
        seen = n
    last = corpus_pipeline.STAGES[-1][1](spark, at, sf)
    assert last.count() == seen and {"doc_id", "ids", "n_tokens"} <= set(last.columns)


def test_pipeline_as_brute_force(spark, sf):
    """All stages again in plain Python: each row's score, all pairs' shingles, all places of all items, the patterns."""
    import hashlib

    import public_tokenizers
    import tiktoken

    from tests.llm.test_texts import KINDS, plain_groups, plain_overlap
    from tidewrack.llm import bytebpe, quality, wordhash

    docs, labels, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    model = quality.train(*quality.sample(docs, labels, 1500, 3000))
    rows = [(r.doc_id, r.text or "") for r in docs.orderBy("doc_id").collect()]
    rows = [r for r, s in zip(rows, model.score(quality.features([t for _, t in rows]))) if s >= quality.THRESHOLD]
    groups = plain_groups([t for _, t in rows], lambda t: wordhash.words_of(t).tolist())
    rows = [r for i, r in enumerate(rows) if groups[i] == i]
    items = [wordhash.words_of(r.text).tolist() for r in bench.collect()]
    held = lambda t: any(plain_overlap(i, wordhash.words_of(t).tolist()) >= 0.8 * len(i) for i in items)  # noqa: E731, items are shorter than the window
    assert max(map(len, items)) <= 60
    rows = [(d, t) for d, t in rows if not held(t)]
    bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.read_ranks(queries.tokenizer_file("byte_bpe_50k.tiktoken")), special_tokens={})
    want = {}
    for d, t in rows:
        spans = sorted((m.start(), m.end()) for _, p, g, least in KINDS for m in p.finditer(t) if len(m[g]) >= least)
        out, at = [], 0
        while spans:
            a, z = spans.pop(0)
            while spans and spans[0][0] <= z:
                z = max(z, spans.pop(0)[1])
            out += [t[at:a], "[secret]"]
            at = z
        t = "".join([*out, t[at:]])
        want[d] = (len(bpe.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want and 0 < len(got) < docs.count()


def test_stages_on_odd_rows(spark, odd, none, sf):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        left[name] = sorted((r.doc_id or 0 for r in stage(spark, docs, sf).collect()))
        assert stage(spark, none, sf).count() == 0
    every = sorted(d or 0 for d, *_ in ODD)
    assert set(left["quality classifier"]) <= set(every)
    assert left["SimHash near-dedup"] == [0, 1, 3, 4, 6, 7, 8, 10]  # 2 is empty like 1; 4 is there twice, and 9 again
    assert left["benchmark decontamination"] == left["secret scans"] == left["byte-level BPE"] == every


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_registered():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert [n.split("_")[0] for n in names if n.split("_")[0][2:].isdigit()] == [f"op{i}" for i in range(1, 11)]
    assert "pipeline" in __spark_entry__.queries() and "op5_secret_scan" in __spark_entry__.oracle_sql()
