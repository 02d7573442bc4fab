"""Nothing is left out: frequent passages, whole logs, all groups."""

from tidewrack.operators import matching, tokens


def test_overlaps_of_frequent_passages(spark):
    words = [f"w{i}" for i in range(30)]
    item = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    # 60 texts hold all of it, 70 only its middle: all its 10-grams occur over 50 times, some of them 130 times
    docs = [(d, f"a{d} " + " ".join(words) + f" z{d}") for d in range(60)] + [(d, f"a{d} " + " ".join(words[8:22])) for d in range(60, 130)]
    docs += [(200, " ".join(words[:9]) + " x " + " ".join(words[11:20]))]
    grams = lambda rows, key: tokens.kgrams(rows, 10, key)
    got = matching.overlaps(grams(item, "item_id"), grams(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id"), 10)
    assert {tuple(r) for r in got.collect()} == {(1, d, 30 if d < 60 else 14) for d in range(130)}


def test_slices_of_whole_logs(spark):
    from tidewrack import catalogue
    from tidewrack.operators import dataflow

    n = 330
    log = [(7, i, i, f"v{i * i % 11}", float(i * 37 % 100)) for i in range(1, n + 1)] + [(8, i, i, "v0", 80.0) for i in range(1, 4)]
    frame = spark.createDataFrame(log, "user_id long, ts long, event_id long, event_type string, value double")
    t = lambda name: frame
    spans = {k: (20 * k + 5, 20 * k + 14) for k in range(17)}
    assert {tuple(r) for r in catalogue._slices(t).collect()} == {(7, k, a, b) for k, (a, b) in spans.items()}
    var, write = {i: v for u, i, _, v, _ in log if u == 7}, {i: x >= 75 for u, i, _, _, x in log if u == 7}
    first = {v: min(i for i in var if var[i] == v) for v in var.values()}
    ins, outs, carried = set(), set(), set()
    for k, (a, b) in spans.items():
        for i in range(a, min(b, n) + 1):
            v, loop = var[i], 60 * (k // 3)
            if first[v] < a:
                ins.add((7, k, v))
            if (write[i] or first[v] >= a) and any(var[j] == v and not write[j] for j in range(b + 1, n + 1)):
                outs.add((7, k, v))
            if write[i] and k % 3 < 2 and first[v] < loop + 4 and any(var[j] == v and not write[j] for j in range(loop + 2, min(loop + 50, n) + 1)):
                carried.add((7, k, v))
    rows = lambda df: {(r.unit, r.slice, r.var) for r in df.collect()}
    assert max(k for _, k, _ in ins) == 16
    assert rows(dataflow.inputs(catalogue._log(t), catalogue._slices(t))) == ins
    assert rows(dataflow.outputs(catalogue._log(t), catalogue._slices(t))) == outs
    loops = spark.createDataFrame([(7, 60 * j + 2, 60 * j + 50, 60 * j + 4) for j in range(6)], "unit long, loop_first int, loop_last int, carry int")
    assert rows(dataflow.outputs(catalogue._log(t), catalogue._slices(t), loops)) == outs | carried


def test_edges_of_all_groups(spark, sf):
    from tidewrack import catalogue

    region = {r.n_nationkey: r.n_regionkey for r in spark.read.parquet(f"{sf}/nation.parquet").collect()}
    nation = {r.s_suppkey: r.s_nationkey for r in spark.read.parquet(f"{sf}/supplier.parquet").collect()}
    want = {(a, b) for a, m in nation.items() for b, n in nation.items() if m != n and region[m] == region[n]}
    assert {tuple(r) for r in catalogue.QUERIES["conditional_group_edges"](spark, sf).collect()} == want


def test_detect_inserted_statement(spark):
    from tidewrack.plans.dedupe import DedupeOptions, detect
    from tidewrack.sources import files

    line = [f"  total = total + call{i}(a, b{i});" for i in range(10)]
    one = "int f(int a) {\n" + "\n".join(line) + "\n}\n"
    two = "int g(int a) {\n" + "\n".join([*line[:5], "  log(total);", *line[5:]]) + "\n}\n"
    report = detect(files.from_memory(spark, {"a.dart": one, "b.dart": two}), DedupeOptions(70, 4))
    (c,) = report.clusters.collect()
    assert (c.n_instances, c.bucket, c.category) == (2, "gapped", "logic")
    assert sorted(r.path for r in report.instances.collect()) == ["a.dart", "b.dart"]
    only = detect(files.from_memory(spark, {"a.dart": one, "b.dart": two}), DedupeOptions(70, 4, bucket="identical"))
    assert only.clusters.count() == 0


def test_clones_of_more_than_fifty_files_are_a_cluster(spark, tmp_path):
    """A cap of 50 in the query and its SQL left them out."""
    from tidewrack import catalogue, catalogue_code  # noqa: F401

    spark.createDataFrame([(i, i // 60) for i in range(62)], "s_suppkey long, s_nationkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    got = sorted(map(tuple, catalogue.QUERIES["dart_clone_clusters"](spark, str(tmp_path)).collect()))
    assert got == [(0, 60, "identical", "logic"), (1, 2, "identical", "logic")]
