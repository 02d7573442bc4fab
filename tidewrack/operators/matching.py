"""Maximal equal token runs between and within texts.

Equal k-grams are seeds. Seeds of two texts on one diagonal whose positions follow one another make an island,
and an island of m seeds is an equal run of m + k - 1 tokens, as long as it can be. Buckets of over
``max_bucket`` occurrences seed nothing, but runs may pass through them: where an island of seeds ends at frequent
k-grams, the run of these in its first text is compared along its diagonal, and what is equal joins the island.

``text_clone_pairs`` does the same for whole texts and moves less. Equal texts are worked on once, and texts without an
equal one are read where they lie. Equal k-grams have
one least hash of their shorter windows: k-grams whose least hash no other place has occur once, and are dropped
where they are made; the others move in runs of one least hash, and are counted where all of these meet. K-grams that
always follow one another become one piece, and pieces are paired.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tidewrack.functions.arrow import bound_batches
from tidewrack.operators import texthash, tokens
from tidewrack.plans.lineage import cut, drop, release, remove, work_dir, written


def _islands(rows: DataFrame, k: int, by: list[str]) -> DataFrame:
    """(by..., start, m) of runs of following ``pos_a`` on a diagonal that hold a seed."""
    diagonal = Window.partitionBy(*by).orderBy("pos_a")
    rows = rows.withColumn("island", F.col("pos_a") - F.row_number().over(diagonal))
    runs = rows.groupBy(*by, "island").agg(F.min("pos_a").alias("start_a"), F.count("*").alias("m"), F.max("seed").alias("seeded"))
    return runs.where("seeded").select(*by, "start_a", (F.col("m") + k - 1).alias("n_tokens"))


def clone_pairs(grams: DataFrame, k: int, max_bucket: int | None = 50) -> DataFrame:
    """(doc_a, start_a, doc_b, start_b, n_tokens) of all maximal runs with a seed; in one text at least ``k`` apart.

    Without ``max_bucket`` all k-grams are seeds.
    """
    sizes = grams.groupBy("h1", "h2").agg(F.count("*").alias("size")).where("size > 1")
    shared = grams.join(sizes, ["h1", "h2"])
    a = shared.select(F.col("doc_id").alias("doc_a"), F.col("pos").alias("pos_a"), "h1", "h2", "size")
    b = shared.select(F.col("doc_id").alias("doc_b"), F.col("pos").alias("pos_b"), "h1", "h2")
    far = (F.col("doc_a") < F.col("doc_b")) | ((F.col("doc_a") == F.col("doc_b")) & (F.col("pos_b") - F.col("pos_a") >= k))
    by = ["doc_a", "doc_b", "diag"]
    diag = (F.col("pos_b") - F.col("pos_a")).alias("diag")
    seeds = a.where(F.lit(True) if max_bucket is None else F.col("size") <= max_bucket).join(b, ["h1", "h2"]).where(far).select("doc_a", "doc_b", diag, "pos_a", F.lit(True).alias("seed"))
    if max_bucket is None:
        runs = _islands(seeds, k, by)
        return runs.select("doc_a", "start_a", "doc_b", (F.col("start_a") + F.col("diag")).alias("start_b"), "n_tokens")
    # through buckets above the cap, where an island ends: there a run of frequent k-grams starts in text a, or one ends
    # where the island starts
    common = shared.where(F.col("size") > max_bucket).select("doc_id", "pos", "h1", "h2")
    run = F.col("pos") - F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    runs = common.withColumn("run", run).groupBy(F.col("doc_id").alias("doc_a"), "run").agg(F.min("pos").alias("low"), F.max("pos").alias("high")).drop("run")
    island = F.col("pos_a") - F.row_number().over(Window.partitionBy(*by).orderBy("pos_a"))
    islands = seeds.withColumn("island", island).groupBy(*by, "island").agg((F.min("pos_a") - 1).alias("before"), (F.max("pos_a") + 1).alias("behind"))
    ends = islands.join(runs.withColumnRenamed("low", "behind"), ["doc_a", "behind"]).select(*by, F.col("behind").alias("low"), "high")
    starts = islands.join(runs.withColumnRenamed("high", "before"), ["doc_a", "before"]).select(*by, "low", F.col("before").alias("high"))
    needed = ends.union(starts).distinct().select(*by, F.explode(F.sequence("low", "high")).alias("pos_a"))
    ca = common.select(F.col("doc_id").alias("doc_a"), F.col("pos").alias("pos_a"), "h1", "h2")
    cb = common.select(F.col("doc_id").alias("doc_b"), F.col("pos").alias("pos_b"), F.col("h1").alias("g1"), F.col("h2").alias("g2"))
    through = needed.withColumn("pos_b", F.col("pos_a") + F.col("diag")).join(cb, ["doc_b", "pos_b"]).join(ca, ["doc_a", "pos_a"])
    through = through.where("h1 = g1 and h2 = g2").select(*by, "pos_a", F.lit(False).alias("seed")).distinct()
    runs = _islands(seeds.union(through), k, by)
    return runs.select("doc_a", "start_a", "doc_b", (F.col("start_a") + F.col("diag")).alias("start_b"), "n_tokens")


#: Bits of the table of least hashes that occur in several places, at the most: a fuller table only drops less.
TABLE_BITS, BITMAP = 27, 4096


def _bit_maps(rows: DataFrame, n: int) -> tuple[int, DataFrame]:
    """(bits, (b, m)): a table of so many bits, of a bounded size, of the ``n`` hashes ``m``, in maps of ``BITMAP`` bytes;
    a hash's place are its last bits."""
    bits = min(TABLE_BITS, max(16, math.ceil(math.log2(16 * n + 1))))
    x = (F.col("m").bitwiseAND((1 << bits) - 1) + 1).alias("x")
    return bits, rows.select(x).groupBy(F.bitmap_bucket_number("x").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("m"))


def _bit_table(rows: DataFrame, n: int) -> np.ndarray:
    """The same table as an array."""
    bits, maps = _bit_maps(rows, n)
    table = np.zeros(max(1 << bits, 8 * BITMAP) // 8, "u1")
    for r in maps.toLocalIterator():
        table[(r.b - 1) * BITMAP : r.b * BITMAP] = np.frombuffer(bytes(r.m), "u1")
    return table[: (1 << bits) // 8]


def _by_copies(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` (text, ...) that have no equal text, and those that may have one; no row moves for it."""
    hashed = F.xxhash64("text")
    several = cut(rows.groupBy(hashed.alias("m")).agg(F.count("*").alias("n")).where("n > 1").select("m"))
    bits, maps = _bit_maps(several, several.count())
    maps = cut(maps.select(F.col("b").alias("_b"), F.col("m").alias("_m")), several)
    place = hashed.bitwiseAND((1 << bits) - 1) + 1
    byte = F.conv(F.hex(F.expr("substring(_m, cast(_at / 8 as int) + 1, 1)")), 16, 10).cast("int")
    found = rows.withColumn("_at", F.bitmap_bit_position(place)).join(F.broadcast(maps), F.bitmap_bucket_number(place) == F.col("_b"), "left")
    there = F.coalesce(F.expr("shiftright(_byte, cast(_at % 8 as int)) & 1 = 1"), F.lit(False))
    found = found.withColumn("_byte", byte).withColumn("_there", there)
    return found.where(~F.col("_there")).select(*rows.columns), found.where("_there").select(*rows.columns)


def _least_hashes(t: texthash.Tokens, running: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, m, g): the places of all k-grams within a text, the least hash of each, and the hashes of all short windows."""
    short = max(1, 2 * k // 5)
    g = texthash.mixed(texthash.windows(running, short))
    ends = t.bounds[1:][t.text]
    places = np.flatnonzero(np.arange(len(t.text)) + k <= ends)
    return places, texthash.least(g, k - short + 1)[places] if len(places) else g[:0], g


def _pieces(texts: DataFrame, k: int) -> DataFrame:
    """(id, start, len, h1, h2, size) of pieces of ``texts`` (id, text, w): ``len`` k-grams in a row which follow one
    another wherever they occur, ``size`` places in all texts, each counted ``w`` times. K-grams of one place are left out."""
    spark = texts.sparkSession
    bound_batches(spark)
    edges = texthash.word_edges(spark)

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(m, often): the different least hashes of each text; ``often`` if the text has one's window more than once."""
        for b in batches:
            for _, part in texthash.chunks(b.column(0).to_pylist()):
                t = texthash.Tokens(part, edges)
                places, m, g = _least_hashes(t, texthash.sums(t.hashes()), k)
                if not len(places):
                    continue
                new = np.ones(len(m), bool)
                new[1:] = (m[1:] != m[:-1]) | (t.text[places[1:]] != t.text[places[:-1]])
                of = texthash.mixed(np.arange(1, len(part) + 1, dtype=np.uint64))  # tells the texts apart
                keys, first = np.unique(m[new] ^ of[t.text[places[new]]], return_index=True)
                every = np.sort(g ^ of[t.text[: len(g)]])
                often = np.isin(keys, every[1:][every[1:] == every[:-1]])
                yield pa.record_batch([pa.array(m[new][first].view("i8")), pa.array(often)], ["m", "often"])

    found = texts.select("text").mapInArrow(least, "m long, often boolean")
    several = found.groupBy("m").agg(F.count("*").alias("n"), F.max("often").alias("often")).where("n > 1 or often").select("m")
    several = cut(several)
    held = spark.sparkContext.broadcast(_bit_table(several, several.count()))
    drop(several)
    release(spark)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of k-grams of one least hash that may occur elsewhere: their hashes, and those before and behind, zero for none.
        Of a text with copies the others too, without hashes."""
        table = held.value
        low = np.uint64(8 * len(table) - 1)
        for b in batches:
            for at, part in texthash.chunks(b.column(1).to_pylist()):
                t = texthash.Tokens(part, edges)
                running = texthash.sums(t.hashes())
                places, m, _ = _least_hashes(t, running, k)
                if not len(places):
                    continue
                bit = m & low
                there = (table[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype("u1")) & 1 == 1
                text = t.text[places]
                w = b.column(2).to_numpy()[at : at + len(part)][text]
                turn = text[1:] != text[:-1]
                new = np.append(True, turn | (there[1:] != there[:-1]) | (there[1:] & (m[1:] != m[:-1])))
                heads = np.flatnonzero(new)
                n = np.diff(np.append(heads, len(places)))
                heads, n = heads[there[heads] | (w[heads] > 1)], n[there[heads] | (w[heads] > 1)]
                # a zero before and behind each text's
                spot = np.arange(len(places)) + 1 + 2 * np.append(0, np.cumsum(turn))
                padded = np.zeros(spot[-1] + 2, np.uint64)
                padded[spot] = texthash.windows(running, k)[places]
                raw = [padded[i - 1 : i + z + 1].tobytes() if x else b"" for i, z, x in zip(spot[heads].tolist(), n.tolist(), there[heads].tolist())]
                cols = [
                    pa.array(m[heads].view("i8")), b.column(0).take(pa.array(text[heads] + at)), pa.array((places[heads] - t.bounds[text[heads]]).astype("i4")),
                    pa.array(n.astype("i4")), pa.array(w[heads]), pa.array(raw, pa.binary()),
                ]
                for k0 in range(0, len(heads), ROWS):
                    yield pa.record_batch([c.slice(k0, ROWS) for c in cols], ["m", "id", "start", "n", "w", "h"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces of runs that come in the order of ``m``: equal k-grams have one least hash, so they are counted here."""
        kept: list[pa.RecordBatch] = []
        for b in batches:
            m = b.column(0).to_numpy()
            if not kept or m[-1] != kept[0].column(0)[0].as_py():
                first = int(np.flatnonzero(m == m[-1])[0])  # the last m may go on
                if ready := kept + [b.slice(0, first)] * (first > 0):
                    yield _counted(pa.Table.from_batches(ready))
                kept = [b.slice(first)]
            else:
                kept.append(b)
        if kept:
            yield _counted(pa.Table.from_batches(kept))

    rows = texts.select("id", "text", "w").mapInArrow(runs, "m long, id long, start int, n int, w long, h binary")
    rows = rows.repartition("m").sortWithinPartitions("m").mapInArrow(parts, "id long, start int, len int, h1 long, h2 long, size long, one_before boolean, one_behind boolean")
    order = Window.partitionBy("id").orderBy("start")
    goes_on = (F.lag(F.col("start") + F.col("len")).over(order) == F.col("start")) & F.lag("one_behind").over(order) & F.col("one_before")
    rows = rows.withColumn("head", F.when(goes_on, 0).otherwise(1))
    rows = rows.withColumn("piece", F.sum("head").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    key = F.min(F.struct("start", "h1", "h2"))
    out = rows.groupBy("id", "piece").agg(key.alias("x"), F.sum("len").cast("int").alias("len"), F.min("size").alias("size"))
    return out.select("id", "x.start", "len", "x.h1", "x.h2", "size")


#: Runs in one batch, at the most.
ROWS = 4000


def _counted(rows: pa.Table) -> pa.RecordBatch:
    """Pieces of all runs of some least hashes: cut where the k-grams before or behind differ, without those of one place.

    ``one_before`` and ``one_behind``: whether the k-gram before the first is the same at all places, and that behind the last.
    """
    m, ids, start, n, w = (rows.column(i).to_numpy() for i in range(5))
    raw = rows.column(5).to_pylist()
    full = np.fromiter(map(len, raw), np.int64, len(raw)) > 0
    h = np.frombuffer(b"".join(raw), "<u8")
    f = np.flatnonzero(full)
    heads = np.cumsum(n[f]) - n[f]  # of each run among all k-grams
    run = np.repeat(np.arange(len(f)), n[f])
    at = np.arange(len(run)) + 1 + 2 * run
    g, before, behind = h[at], h[at - 1], h[at + 1]
    order = np.lexsort((g, m[f][run]))
    gs, ms = g[order], m[f][run][order]
    new = np.append(True, (gs[1:] != gs[:-1]) | (ms[1:] != ms[:-1]))[: len(gs)]
    first = np.flatnonzero(new)
    of = np.empty(len(gs), np.int64)
    of[order] = np.cumsum(new) - 1
    if len(gs):
        size = np.add.reduceat(w[f][run][order], first)
        same = [np.minimum.reduceat(x[order], first) == np.maximum.reduceat(x[order], first) for x in (before, behind)]
        left, right = (s & (x[order][first] != 0) for s, x in zip(same, (before, behind)))
        size, left, right = size[of], left[of], right[of]
    else:
        size, left, right = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, bool)
    opens = np.append(True, ~(left[1:] & right[:-1]))[: len(gs)]
    opens[heads] = True
    head = np.flatnonzero(opens)
    length = np.diff(np.append(head, len(gs)))
    some = size[head] > 1
    head, length = head[some], length[some]
    r = f[run[head]]
    plain = np.flatnonzero(~full)
    none = np.zeros(len(plain), bool)
    cols = [
        (ids[r], ids[plain]), ((start[r] + head - heads[run[head]]).astype("i4"), start[plain]), (length.astype("i4"), n[plain]), (m[r], m[plain]),
        (g[head].view("i8"), -1 - start[plain].astype("i8")), (size[head], w[plain]), (left[head], none), (right[head + length - 1], none),
    ]
    return pa.record_batch([pa.array(np.concatenate(c)) for c in cols], ["id", "start", "len", "h1", "h2", "size", "one_before", "one_behind"])


def _told_apart(docs: DataFrame) -> bool:
    """Whether doc_ids are whole numbers, none missing and none there twice."""
    n = docs.agg(F.count("*").alias("rows"), F.countDistinct("doc_id").alias("ids")).first()
    return n.rows == n.ids and isinstance(docs.schema["doc_id"].dataType, IntegralType)


def _distinct_texts(docs: DataFrame, k: int) -> tuple[DataFrame, str]:
    """(id, text, w, docs) of the different texts long enough for a k-gram, with the doc_ids that have each, and the folder
    that holds those with copies; the others are read where they lie."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).where(F.length("text") >= k)
    alone, copies = _by_copies(rows)
    alone = alone.select(F.col("doc_id").alias("id"), "text", F.lit(1).cast("long").alias("w"), F.array("doc_id").alias("docs"))
    equal = copies.groupBy(F.unhex(F.md5("text")).alias("d")).agg(F.min("doc_id").alias("id"), F.first("text").alias("text"), F.count("*").alias("w"), F.collect_list("doc_id").alias("docs"))
    folder = work_dir(docs.sparkSession, "texts")
    equal = written(equal.select("id", "text", "w", "docs"), folder)
    release(docs.sparkSession)
    return alone.union(equal), folder


def text_clone_pairs(docs: DataFrame, k: int, max_bucket: int = 50) -> DataFrame:
    """What ``clone_pairs`` gives for the k-grams of ``docs`` (doc_id, text).

    Where doc_ids repeat, miss or aren't whole numbers, k-grams go through ``clone_pairs`` themselves.
    """
    spark = docs.sparkSession
    if not _told_apart(docs):
        return clone_pairs(cut(tokens.kgrams(docs, k)), k, max_bucket)
    equal, folder = _distinct_texts(docs, k)
    pieces = cut(_pieces(equal, k))
    members = cut(equal.select("id", "docs").join(pieces.select("id").distinct(), "id", "left_semi").select("id", F.explode("docs").alias("doc_id")))
    remove(spark, folder)
    release(spark)
    copied = members.groupBy("id").agg(F.count("*").alias("w"))

    # islands (x, y, diag) of two texts, x not above y; of a text with itself diagonals from 0 on, on which its copies lie
    by = ["x", "y", "diag"]
    few = pieces.where(F.col("size") <= max_bucket).join(copied, "id")
    a = few.select(F.col("id").alias("x"), F.col("start").alias("pos"), "len", "h1", "h2", "w")
    b = few.select(F.col("id").alias("y"), F.col("start").alias("pos_y"), "h1", "h2")
    diag = (F.col("pos_y") - F.col("pos")).alias("diag")
    wanted = (F.col("x") < F.col("y")) | ((F.col("x") == F.col("y")) & ((F.col("pos_y") - F.col("pos") >= k) | ((F.col("pos_y") >= F.col("pos")) & (F.col("w") > 1))))
    seeds = cut(a.join(b, ["h1", "h2"]).where(wanted).select(*by[:2], diag, "pos", "len", F.lit(True).alias("seed")))
    release(spark)
    islands = _laid(seeds, by).groupBy(*by, "island").agg(F.min("pos").alias("before"), F.max(F.col("pos") + F.col("len")).alias("behind"))
    # through pieces above the cap, where an island ends or starts: a piece starts there, as its neighbour is below it
    often = _laid(pieces.where(F.col("size") > max_bucket).withColumnRenamed("start", "pos"), ["id"]).withColumnRenamed("island", "run")
    runs = often.groupBy(F.col("id").alias("x"), "run").agg(F.min("pos").alias("behind"), F.max(F.col("pos") + F.col("len")).alias("before"))
    ends = islands.select(*by, "behind").join(runs.select("x", "run", "behind"), ["x", "behind"])
    starts = islands.select(*by, "before").join(runs.select("x", "run", "before"), ["x", "before"])
    near = ends.select(*by, "run").union(starts.select(*by, "run")).distinct()
    ca = often.select(F.col("id").alias("x"), "run", "pos", "len", "h1", "h2")
    cb = often.select(F.col("id").alias("y"), F.col("pos").alias("pos_y"), F.col("h1").alias("g1"), F.col("h2").alias("g2"))
    through = near.join(ca, ["x", "run"]).withColumn("pos_y", F.col("pos") + F.col("diag")).join(cb, ["y", "pos_y"]).where("h1 = g1 and h2 = g2")
    through = through.select(*by, "pos", "len", F.lit(False).alias("seed"))
    whole = _laid(seeds.union(through), by).groupBy(*by, "island").agg(F.min("pos").alias("pos"), (F.sum("len") + k - 1).alias("n_tokens"), F.max("seed").alias("seeded"))
    # each copy of the one text with each of the other; with itself, only what is far enough apart
    whole = whole.where("seeded").select(*by, "pos", "n_tokens")
    each = whole.join(members.select(F.col("id").alias("x"), F.col("doc_id").alias("a")), "x").join(members.select(F.col("id").alias("y"), F.col("doc_id").alias("b")), "y")
    each = each.where((F.col("a") < F.col("b")) | ((F.col("a") > F.col("b")) & ((F.col("x") < F.col("y")) | (F.col("diag") > 0))) | ((F.col("a") == F.col("b")) & (F.col("diag") >= k)))
    swap, other = F.col("a") > F.col("b"), F.col("pos") + F.col("diag")
    return each.select(
        F.least("a", "b").alias("doc_a"), F.when(swap, other).otherwise(F.col("pos")).cast("int").alias("start_a"),
        F.greatest("a", "b").alias("doc_b"), F.when(swap, F.col("pos")).otherwise(other).cast("int").alias("start_b"), "n_tokens",
    )


#: Places of a piece in one task, at the most, that the same places of another text are paired with.
SHARE = 4000


def whole_maximal_pairs(pieces: DataFrame, k: int) -> DataFrame:
    """(doc_a, start_a, doc_b, start_b, n_tokens): what ``maximal_pairs`` leaves of all equal runs of ``pieces`` (id,
    start, len, h1, h2), however frequent.

    Only places are paired at which a run starts or ends, as the pieces before or behind differ: within long or often
    repeated runs most places have equal neighbours, and are told apart by these before any pair is made.
    """
    order = Window.partitionBy("id").orderBy("start")
    g, end = F.xxhash64("h1", "h2"), F.col("start") + F.col("len")
    left, right = F.when(F.lag(end).over(order) == F.col("start"), F.lag(g).over(order)), F.when(F.lead("start").over(order) == end, F.lead(g).over(order))
    places = pieces.select("id", "start", "len", "h1", "h2", left.alias("left"), right.alias("right"))
    around = F.xxhash64(F.col("left").isNull(), "left", F.col("right").isNull(), "right")
    places = cut(places.withColumn("c", around))
    kinds = cut(places.groupBy("h1", "h2", "c").agg(F.first("left").alias("left"), F.first("right").alias("right"), F.count("*").alias("n")))
    share = F.ceil(F.col("n") / SHARE).cast("int")
    a = kinds.select("h1", "h2", F.col("c").alias("c_a"), F.col("left").alias("l"), F.col("right").alias("r"))
    b = kinds.select("h1", "h2", F.col("c").alias("c_b"), "left", "right", share.alias("shares"))
    differ = lambda x, y: F.coalesce(F.col(x) != F.col(y), F.lit(True))
    met = a.join(b, ["h1", "h2"]).select("h1", "h2", "c_a", "c_b", "shares", differ("l", "left").alias("opens"), differ("r", "right").alias("closes")).where("opens or closes")
    xs = places.select("h1", "h2", F.col("c").alias("c_a"), F.col("id").alias("x"), F.col("start").alias("pos"), "len")
    xs = met.join(xs, ["h1", "h2", "c_a"]).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("c_a", "shares")
    ys = places.join(kinds.select("h1", "h2", "c", share.alias("shares")), ["h1", "h2", "c"])
    ys = ys.select("h1", "h2", F.col("c").alias("c_b"), F.pmod(F.xxhash64("id", "start"), "shares").cast("int").alias("share"), F.col("id").alias("y"), F.col("start").alias("pos_y"))
    wanted = (F.col("x") < F.col("y")) | ((F.col("x") == F.col("y")) & (F.col("pos_y") - F.col("pos") >= k))
    rows = xs.join(ys, ["h1", "h2", "c_b", "share"]).where(wanted).select("x", "y", (F.col("pos_y") - F.col("pos")).alias("diag"), "pos", "len", "opens", "closes")
    of = dict(places.dtypes)["id"]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of rows that come in the order of x, y, diag, pos: a run goes from one that opens to the next that closes."""
        kept: list[pa.RecordBatch] = []
        for b in batches:
            x, y = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            last = len(x) - 1
            if last < 0:
                continue
            if not kept or (x[last], y[last]) != (kept[0].column(0)[0].as_py(), kept[0].column(1)[0].as_py()):
                first = int(np.flatnonzero((x == x[last]) & (y == y[last]))[0])  # the last two texts may go on
                if ready := kept + [b.slice(0, first)] * (first > 0):
                    yield from _longest(pa.Table.from_batches(ready), k)
                kept = [b.slice(first)]
            else:
                kept.append(b)
        if kept:
            yield from _longest(pa.Table.from_batches(kept), k)

    rows = rows.repartition("x", "y").sortWithinPartitions("x", "y", "diag", "pos")
    return rows.mapInArrow(found, f"doc_a {of}, start_a int, doc_b {of}, start_b int, n_tokens int")


def _longest(rows: pa.Table, k: int) -> Iterator[pa.RecordBatch]:
    """The runs of all rows of some pairs of texts, without those that lie, both sides, inside a longer one of the same pair."""
    x, y, diag, pos, size = (rows.column(i).to_numpy() for i in range(5))
    opens, closes = (rows.column(i).to_numpy() for i in (5, 6))
    heads, tails = np.flatnonzero(opens), np.flatnonzero(closes)
    low, other = pos[heads].astype("i8"), (pos[heads] + diag[heads]).astype("i8")
    n = pos[tails] + size[tails] - pos[heads] + k - 1
    x, y = x[heads], y[heads]
    turn = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
    stop = np.append(turn[1:], len(x))
    alive = np.ones(len(x), bool)
    for s, e in zip(turn[stop - turn > 1].tolist(), stop[stop - turn > 1].tolist()):
        a, b, m, left = low[s:e], other[s:e], n[s:e], alive[s:e]
        sides = [(a, b), (b, a)] if x[s] == y[s] else [(a, b)]
        for i in np.argsort(-m, kind="stable").tolist():
            if left[i]:
                for p, q in sides:
                    left &= ~((a >= p[i]) & (a + m <= p[i] + m[i]) & (b >= q[i]) & (b + m <= q[i] + m[i]) & (m < m[i]))
    at = np.flatnonzero(alive)
    ids = [rows.column(i).combine_chunks().take(pa.array(heads[at])) for i in (0, 1)]
    ids = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in ids]
    cols = [ids[0], pa.array(low[at].astype("i4")), ids[1], pa.array(other[at].astype("i4")), pa.array(n[at].astype("i4"))]
    for k0 in range(0, len(at), 10 * ROWS):
        yield pa.record_batch([c.slice(k0, 10 * ROWS) for c in cols], ["doc_a", "start_a", "doc_b", "start_b", "n_tokens"])


def whole_text_pairs(docs: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, copied, members): the maximal pairs of the different texts of ``docs`` (doc_id, text), however frequent, by id;
    (doc_id, start, n_tokens) of whole texts that have copies, by id; (id, doc_id) of the texts that have an id's text.

    Two copies have no other pair than their whole texts, and each has the pairs that the other has with third texts and
    with itself, so nothing is lost where copies aren't paired. Where doc_ids repeat, miss or aren't whole numbers, each
    stands for itself.
    """
    if not _told_apart(docs):
        pairs = cut(maximal_pairs(cut(clone_pairs(cut(tokens.kgrams(docs, k)), k, None))))
        ids = pairs.select(F.col("doc_a").alias("id")).union(pairs.select("doc_b")).distinct()
        return pairs, pairs.limit(0).select(F.col("doc_a").alias("doc_id"), F.col("start_a").alias("start"), "n_tokens"), ids.select("id", F.col("id").alias("doc_id"))
    equal, folder = _distinct_texts(docs, k)
    pairs = cut(whole_maximal_pairs(_pieces(equal.withColumn("w", F.lit(1).cast("long")), k), k))
    counts = tokens.token_counts(equal.where("w > 1").select(F.col("id").alias("doc_id"), "text"))
    copied = cut(counts.where(F.col("n_tokens") >= k).select("doc_id", F.lit(0).alias("start"), F.col("n_tokens").cast("int").alias("n_tokens")))
    ids = pairs.select(F.col("doc_a").alias("id")).union(pairs.select("doc_b")).union(copied.select("doc_id")).distinct()
    members = cut(equal.select("id", "docs").join(ids, "id", "left_semi").select("id", F.explode("docs").alias("doc_id")))
    remove(docs.sparkSession, folder)
    release(docs.sparkSession)
    return pairs, copied, members


def _laid(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` (by..., pos, len), which don't overlap, with ``island``, one number for those that touch."""
    before = F.sum("len").over(Window.partitionBy(*by).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("island", F.col("pos") - F.coalesce(before, F.lit(0)))


def side_length(pairs: DataFrame, side: str, of: str = "") -> F.Column:
    """The tokens of a side of pairs: n_a and n_b if the two differ, else n_tokens."""
    return F.col(of + (f"n_{side}" if f"n_{side}" in pairs.columns else "n_tokens"))


#: Tokens of a bin: pairs are compared that have one in common.
BIN = 64


def maximal_pairs(pairs: DataFrame) -> DataFrame:
    """``pairs`` without those that lie, both sides, inside a longer pair of the same two texts, either way round.

    A longer pair is laid out in the bins that its side covers, so a pair meets those only that cover its start.
    """
    bins = lambda start, n: F.explode(F.sequence(F.floor(start / BIN), F.floor((start + n - 1) / BIN))).alias("bin")

    def laid(a: str, b: str) -> list:
        sides = ((F.col(f"start_{s}"), side_length(pairs, s)) for s in (a, b))
        (start, n), (other, m) = sides
        return ["doc_a", "doc_b", start.alias("low_a"), (start + n).alias("high_a"), other.alias("low_b"), (other + m).alias("high_b"), (n + m).alias("total"), bins(start, n)]

    covers = pairs.select(*laid("a", "b")).union(pairs.where("doc_a = doc_b").select(*laid("b", "a")))
    n_a, n_b = side_length(pairs, "a", "p."), side_length(pairs, "b", "p.")
    p, q = pairs.withColumn("bin", F.floor(F.col("start_a") / BIN)).alias("p"), covers.alias("q")
    same = (F.col("p.doc_a") == F.col("q.doc_a")) & (F.col("p.doc_b") == F.col("q.doc_b")) & (F.col("p.bin") == F.col("q.bin"))
    inside = (F.col("p.start_a") >= F.col("low_a")) & (F.col("p.start_a") + n_a <= F.col("high_a")) & (F.col("p.start_b") >= F.col("low_b")) & (F.col("p.start_b") + n_b <= F.col("high_b"))
    return p.join(q, same & inside & (F.col("total") > n_a + n_b), "left_anti").select(*pairs.columns)


def overlaps(left: DataFrame, right: DataFrame, k: int, salts: int = 16) -> DataFrame:
    """(item_id, doc_id, n_tokens): the longest equal run of each item and document that share one.

    ``left`` are k-grams by item_id, a bounded side; ``right`` those of all texts by doc_id. None is too frequent:
    each of ``left`` is there for every salt, so that the occurrences of a frequent one are dealt to ``salts`` keys.
    """
    few = left.withColumnRenamed("pos", "pos_a").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = right.withColumnRenamed("pos", "pos_b").withColumn("salt", F.pmod(F.xxhash64("doc_id", "pos_b"), F.lit(salts)).cast("int"))
    seeds = few.join(dealt, ["h1", "h2", "salt"])
    rows = seeds.select("item_id", "doc_id", (F.col("pos_b") - F.col("pos_a")).alias("diag"), "pos_a", F.lit(True).alias("seed"))
    runs = _islands(rows, k, ["item_id", "doc_id", "diag"])
    return runs.groupBy("item_id", "doc_id").agg(F.max("n_tokens").alias("n_tokens"))
