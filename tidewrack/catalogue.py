"""The registered queries over the supplied tables, and the same in DuckDB's SQL where it can say it.

Texts of ``documents`` are files, their lines statements; ``orders`` before and after a day are two snapshots;
parts that are bought together are a graph; each user's ``events`` are a log of variable uses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.functions import globs
from tidewrack.operators import clusters, complexity, dataflow, graph, matching, ranges, similarity, tokens
from tidewrack.plans.lineage import cut, release
from tidewrack.session import table
from tidewrack.sources import cache

K, ITEM_K, CAP = 40, 10, 50
SPLIT_DAY = "1998-04-25"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a function of (read a table by name) as a query; whole numbers come as bigint."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(lambda name: table(spark, sf_dir, name))
            return df.select(*(F.col(c).cast("bigint").alias(c) if t in ("int", "smallint") else F.col(c) for c, t in df.dtypes))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


TOK = r"regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]')"
NORM = "CASE WHEN regexp_matches({t}, '^[0-9]+$') THEN '<NUM>' ELSE {t} END"
TOKS_CTE = f"tk AS (SELECT doc_id, {TOK} AS o, list_transform({TOK}, lambda t: {NORM.format(t='t')}) AS t FROM documents)"
LINES_CTE = f"""ln AS (SELECT doc_id, line, n, CAST(coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first
  FROM (SELECT doc_id, i - 1 AS line, len({TOK.replace("coalesce(text, '')", "l[i]")}) AS n FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))))"""
GRAMS_CTE = f"""{TOKS_CTE}, kg AS (SELECT doc_id, i - 1 AS pos, md5(array_to_string(t[i:i + {K - 1}], ' ')) AS h
  FROM (SELECT doc_id, t, unnest(range(1, len(t) - {K} + 2)) AS i FROM tk WHERE len(t) >= {K}))"""
PAIRS_CTE = f"""{GRAMS_CTE}, sz AS (SELECT h, count(*) AS size FROM kg GROUP BY h HAVING count(*) > 1),
sh AS (SELECT doc_id, pos, h, size FROM kg JOIN sz USING (h)),
al AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, b.pos - a.pos AS diag, a.pos AS pos_a, a.size <= {CAP} AS seed FROM sh a JOIN sh b ON a.h = b.h
  WHERE a.size <= {CAP} AND (a.doc_id < b.doc_id OR (a.doc_id = b.doc_id AND b.pos - a.pos >= {K}))),
th AS (SELECT d.doc_a, d.doc_b, d.diag, a.pos AS pos_a, false AS seed FROM (SELECT DISTINCT doc_a, doc_b, diag FROM al) d
  JOIN sh a ON a.doc_id = d.doc_a AND a.size > {CAP} JOIN sh b ON b.doc_id = d.doc_b AND b.pos = a.pos + d.diag AND b.h = a.h),
isl AS (SELECT *, pos_a - row_number() OVER (PARTITION BY doc_a, doc_b, diag ORDER BY pos_a) AS g FROM (SELECT * FROM al UNION ALL SELECT * FROM th)),
pairs AS (SELECT doc_a, min(pos_a) AS start_a, doc_b, min(pos_a) + diag AS start_b, count(*) + {K - 1} AS n_tokens FROM isl GROUP BY doc_a, doc_b, diag, g HAVING bool_or(seed)),
mx AS (SELECT * FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM pairs q WHERE q.doc_a = p.doc_a AND q.doc_b = p.doc_b AND q.n_tokens > p.n_tokens AND (
  (p.start_a >= q.start_a AND p.start_a + p.n_tokens <= q.start_a + q.n_tokens AND p.start_b >= q.start_b AND p.start_b + p.n_tokens <= q.start_b + q.n_tokens)
  OR (p.doc_a = p.doc_b AND p.start_a >= q.start_b AND p.start_a + p.n_tokens <= q.start_b + q.n_tokens AND p.start_b >= q.start_a AND p.start_b + p.n_tokens <= q.start_a + q.n_tokens))))"""
SPANS_CTE = f"""{PAIRS_CTE}, {LINES_CTE},
v AS (SELECT doc_a AS doc_id, start_a AS start, n_tokens FROM mx UNION SELECT doc_b, start_b, n_tokens FROM mx),
vi AS (SELECT *, row_number() OVER (ORDER BY doc_id, start, n_tokens) AS id FROM v),
ed AS (SELECT a.id AS x, b.id AS y FROM mx JOIN vi a ON (a.doc_id, a.start, a.n_tokens) = (doc_a, start_a, mx.n_tokens) JOIN vi b ON (b.doc_id, b.start, b.n_tokens) = (doc_b, start_b, mx.n_tokens)),
bi AS (SELECT x, y FROM ed UNION SELECT y, x FROM ed),
rc AS (SELECT id AS node, id AS root FROM vi UNION SELECT bi.y, rc.root FROM rc JOIN bi ON bi.x = rc.node),
lab AS (SELECT node, min(root) AS cluster FROM rc GROUP BY node),
sp AS (SELECT cluster, doc_id, start, n_tokens FROM vi JOIN lab ON lab.node = vi.id),
pl AS (SELECT cluster, sp.doc_id, start, n_tokens, min(line) AS first_line, max(line) AS last_line FROM sp JOIN ln ON ln.doc_id = sp.doc_id AND ln.n > 0
  AND ln.first < start + n_tokens AND ln.first + ln.n > start GROUP BY cluster, sp.doc_id, start, n_tokens),
dl AS (SELECT DISTINCT doc_id, unnest(range(first_line, last_line + 1)) AS line FROM pl)"""
# without the cap: all k-grams are seeds
WHOLE_PAIRS_CTE = f"""{GRAMS_CTE}, isl AS (SELECT *, pos_a - row_number() OVER (PARTITION BY doc_a, doc_b, diag ORDER BY pos_a) AS g FROM (
  SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, b.pos - a.pos AS diag, a.pos AS pos_a, true AS seed FROM kg a JOIN kg b ON a.h = b.h
  WHERE a.doc_id < b.doc_id OR (a.doc_id = b.doc_id AND b.pos - a.pos >= {K}))),
{PAIRS_CTE[PAIRS_CTE.index("pairs AS ("):]}"""
WHOLE_SPANS_CTE = SPANS_CTE.replace(PAIRS_CTE, WHOLE_PAIRS_CTE)
METRICS_CTE = f"""{SPANS_CTE}, fm AS (SELECT tk.doc_id, l.total_lines, coalesce(d.dup_lines, 0) AS dup_lines, len(tk.t) AS total_tokens, coalesce(d.dup_tokens, 0) AS dup_tokens,
  round(coalesce(d.dup_lines, 0) / l.total_lines * 100, 6) AS dup_pct, coalesce(c.n_clusters, 0) AS n_clusters
  FROM tk JOIN (SELECT doc_id, count(*) AS total_lines FROM ln GROUP BY doc_id) l ON l.doc_id = tk.doc_id
  LEFT JOIN (SELECT dl.doc_id, count(*) AS dup_lines, CAST(sum(n) AS BIGINT) AS dup_tokens FROM dl JOIN ln ON ln.doc_id = dl.doc_id AND ln.line = dl.line GROUP BY dl.doc_id) d ON d.doc_id = tk.doc_id
  LEFT JOIN (SELECT doc_id, count(DISTINCT cluster) AS n_clusters FROM pl GROUP BY doc_id) c ON c.doc_id = tk.doc_id)"""
UNITS_CTE = "un AS (SELECT doc_id, s FROM (SELECT doc_id, list_distinct(list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: l <> '')) AS s FROM documents) WHERE len(s) >= 2)"
SIG_CTE = f"""{UNITS_CTE}, hx AS (SELECT doc_id, CAST('0x' || substr(md5(unnest(s)), 1, 7) AS BIGINT) AS x FROM un),
sig AS (SELECT doc_id, slot, min((CASE slot {' '.join(f'WHEN {i} THEN x * {a} + {b}' for i, (a, b) in enumerate(similarity.COEFFICIENTS))} END) % {similarity.MODULUS}) AS value
  FROM hx, (SELECT unnest(range({similarity.BANDS * similarity.ROWS})) AS slot) GROUP BY doc_id, slot)"""
CAND_CTE = f"""{SIG_CTE}, bk AS (SELECT a.doc_id, a.slot // 2 AS band, a.value AS r0, b.value AS r1 FROM sig a JOIN sig b ON a.doc_id = b.doc_id AND b.slot = a.slot + 1 AND a.slot % 2 = 0),
bs AS (SELECT band, r0, r1 FROM bk GROUP BY ALL HAVING count(*) BETWEEN 2 AND {CAP}),
fw AS (SELECT bk.* FROM bk JOIN bs USING (band, r0, r1)),
cand AS (SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM fw a JOIN fw b USING (band, r0, r1) WHERE a.doc_id < b.doc_id)"""
NEAR_CTE = f"""{CAND_CTE}, near AS (SELECT doc_a, doc_b, round(j, 6) AS jaccard FROM (SELECT doc_a, doc_b, len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) AS j
  FROM cand JOIN un a ON a.doc_id = doc_a JOIN un b ON b.doc_id = doc_b) WHERE j >= 0.8)"""
COMP_CTE = f"""{NEAR_CTE}, bi AS (SELECT doc_a AS x, doc_b AS y FROM near UNION SELECT doc_b, doc_a FROM near),
rc AS (SELECT x AS node, x AS root FROM bi UNION SELECT bi.y, rc.root FROM rc JOIN bi ON bi.x = rc.node),
comp AS (SELECT node AS doc_id, min(root) AS component FROM rc GROUP BY node)"""
ROLL_CTE = f"""{COMP_CTE}, ct AS (SELECT doc_id, len({TOK}) AS n_tokens, len(string_split(coalesce(text, ''), chr(10))) AS n_lines FROM documents),
roll AS (SELECT component, count(*) AS n_instances, min_by(n_tokens, doc_id) AS token_count, CAST(round(avg(n_lines)) AS BIGINT) AS line_count,
  CAST(sum(n_lines) - min_by(n_lines, doc_id) AS BIGINT) AS lines_saved FROM comp JOIN ct USING (doc_id) GROUP BY component)"""
CAT_CTE = f"""{ROLL_CTE}, cat AS (SELECT component, CASE WHEN plate > 0 AND plate >= control THEN 'boilerplate' WHEN control > 0 THEN 'logic' WHEN data > n / 2 THEN 'data' ELSE 'logic' END AS category
  FROM (SELECT component, len(t) AS n, len(list_filter(t, lambda x: x IN {clusters.CONTROL})) AS control, len(list_filter(t, lambda x: x IN {clusters.BOILERPLATE})) AS plate,
    len(list_filter(t, lambda x: regexp_matches(x, '^[0-9]+$') OR x IN {clusters.LITERAL})) AS data FROM (SELECT component, {TOK} AS t FROM comp JOIN documents USING (doc_id) WHERE doc_id = component)))"""


# tokens and k-grams


@query(f"SELECT doc_id, CAST(len({TOK}) AS BIGINT) AS n_tokens, CAST(len(string_split(coalesce(text, ''), chr(10))) AS BIGINT) AS n_lines FROM documents")
def tokens_per_doc(t):
    return tokens.token_counts(t("documents"))


@query(rf"""SELECT CASE WHEN regexp_matches(t, '^[0-9]+$') THEN '<NUM>' WHEN regexp_matches(t, '^[\p{{L}}_][\p{{L}}\p{{N}}_]*$') THEN '<ID>' ELSE 'mark' END AS norm_kind, count(*) AS n
FROM (SELECT unnest({TOK}) AS t FROM documents) GROUP BY 1""")
def normalized_token_counts(t):
    return tokens.norm_kind_counts(t("documents"), ignore_identifiers=True)


@query(f"WITH {GRAMS_CTE} SELECT bucket_size, count(*) AS n_buckets FROM (SELECT count(*) AS bucket_size FROM kg GROUP BY h) GROUP BY bucket_size")
def kgram_buckets(t):
    return tokens.bucket_sizes(tokens.kgrams(t("documents"), K))


_made: dict[tuple, DataFrame] = {}


def once(make):
    """``make(t)``, computed once for the same files of ``documents`` in an application: several queries start from it."""

    def run(t) -> DataFrame:
        docs = t("documents")
        of = cache.fingerprint(docs)
        key = (docs.sparkSession.sparkContext.applicationId, id(docs.sparkSession), of, make.__name__)
        if of is None:
            return cut(make(t))
        if key not in _made:
            _made[key] = cut(make(t))
            release(docs.sparkSession)
        return _made[key]

    return run


@once
def _pairs(t) -> DataFrame:
    return matching.text_clone_pairs(t("documents"), K, CAP)


@once
def _maximal(t) -> DataFrame:
    return matching.maximal_pairs(_pairs(t))


@query(f"WITH {PAIRS_CTE} SELECT * FROM pairs")
def exact_clone_pairs(t):
    return _pairs(t)


@query(f"WITH {PAIRS_CTE} SELECT * FROM mx")
def maximal_clone_pairs(t):
    return _maximal(t)


@once
def _spans(t) -> DataFrame:
    return clusters.spans(_maximal(t))


@once
def _placed(t) -> DataFrame:
    return clusters.span_lines(_spans(t), t("documents"))


@query(f"WITH RECURSIVE {SPANS_CTE} SELECT c.doc_id AS first_doc, c.start AS first_start, n.n_spans, n.n_docs FROM (SELECT cluster, count(*) AS n_spans, count(DISTINCT doc_id) AS n_docs FROM pl GROUP BY cluster) n JOIN vi c ON c.id = n.cluster")
def span_clusters(t):
    """Components of equal spans: where the first one lies, how many spans and texts."""
    first = F.min(F.struct("doc_id", "start", "n_tokens"))
    rows = _placed(t).groupBy("cluster").agg(first.alias("f"), F.count("*").alias("n_spans"), F.countDistinct("doc_id").alias("n_docs"))
    return rows.select(F.col("f.doc_id").alias("first_doc"), F.col("f.start").alias("first_start"), "n_spans", "n_docs")


@query(f"""WITH RECURSIVE {WHOLE_SPANS_CTE}, rk AS (SELECT *, row_number() OVER (PARTITION BY cluster, doc_id ORDER BY n_tokens DESC, start) AS i FROM sp),
gr AS (SELECT DISTINCT cluster, doc_id, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(s BIGINT, n BIGINT)[]) AS kept FROM rk UNION ALL
  SELECT gr.cluster, gr.doc_id, rk.i, CASE WHEN len(list_filter(kept, lambda k: rk.start < k.s + k.n AND k.s < rk.start + rk.n_tokens)) = 0 THEN list_append(kept, {{'s': CAST(rk.start AS BIGINT), 'n': CAST(rk.n_tokens AS BIGINT)}}) ELSE kept END
  FROM gr JOIN rk ON rk.cluster = gr.cluster AND rk.doc_id = gr.doc_id AND rk.i = gr.i + 1),
ks AS (SELECT cluster, doc_id, unnest(kept) AS k FROM (SELECT cluster, doc_id, arg_max(kept, i) AS kept FROM gr GROUP BY cluster, doc_id))
SELECT DISTINCT doc_id, k.s AS start, k.n AS n_tokens FROM ks WHERE cluster IN (SELECT cluster FROM ks GROUP BY cluster HAVING count(*) >= 2)""")
def span_clusters_without_overlaps(t):
    """Spans that stay in their clusters after overlaps are removed, in greedy order; no k-gram is too frequent."""
    return clusters.whole_without_overlaps(t("documents"), K)


@query(f"WITH RECURSIVE {METRICS_CTE} SELECT * FROM fm")
def file_dup_metrics(t):
    return clusters.file_metrics(_placed(t), t("documents"))


@query(f"""WITH RECURSIVE {METRICS_CTE}, sv AS (SELECT count(*) AS clusters, CAST(coalesce(sum(s), 0) AS BIGINT) AS saved FROM (
  SELECT cluster, sum(last_line - first_line + 1) - min_by(last_line - first_line + 1, (doc_id, start)) AS s FROM pl GROUP BY cluster))
SELECT files, files_with_dup, clusters, total_lines, dup_lines, total_tokens, dup_tokens, least(saved, dup_lines) AS lines_saved, round(dup_lines / total_lines * 100, 6) AS dup_pct, dup_lines / total_lines * 100 > 5 AS fails
FROM (SELECT count(*) AS files, count(*) FILTER (dup_lines > 0) AS files_with_dup, CAST(sum(total_lines) AS BIGINT) AS total_lines, CAST(sum(dup_lines) AS BIGINT) AS dup_lines,
  CAST(sum(total_tokens) AS BIGINT) AS total_tokens, CAST(sum(dup_tokens) AS BIGINT) AS dup_tokens FROM fm), sv""")
def dup_summary(t):
    placed = _placed(t)
    return clusters.summary(clusters.file_metrics(placed, t("documents")), placed)


_A = [("item_id", "benchmark", "it"), ("doc_id", "documents", "dk")]


@query(
    "WITH "
    + ", ".join(
        f"{n}0 AS (SELECT {k}, list_transform({TOK}, lambda t: {NORM.format(t='t')}) AS t FROM {b}), "
        f"{n} AS (SELECT {k}, i - 1 AS pos, md5(array_to_string(t[i:i + {ITEM_K - 1}], ' ')) AS h FROM (SELECT {k}, t, unnest(range(1, len(t) - {ITEM_K} + 2)) AS i FROM {n}0 WHERE len(t) >= {ITEM_K}))"
        for k, b, n in _A
    )
    + f""", ok AS (SELECT h FROM dk GROUP BY h HAVING count(*) <= {CAP}),
isl AS (SELECT item_id, doc_id, dk.pos - it.pos AS diag, it.pos - row_number() OVER (PARTITION BY item_id, doc_id, dk.pos - it.pos ORDER BY it.pos) AS g FROM it JOIN ok USING (h) JOIN dk USING (h))
SELECT item_id, doc_id, max(n) + {ITEM_K - 1} AS n_tokens FROM (SELECT item_id, doc_id, diag, g, count(*) AS n FROM isl GROUP BY ALL) GROUP BY item_id, doc_id"""
)
def benchmark_overlap(t):
    left, right = tokens.kgrams(t("benchmark"), ITEM_K, "item_id"), tokens.kgrams(t("documents"), ITEM_K)
    return matching.overlaps(left, right, ITEM_K)


# similarity of statement sets


def _units(t) -> tuple[DataFrame, DataFrame]:
    units = similarity.units(t("documents"))
    return units, similarity.signatures(units)


@query(f"WITH {SIG_CTE} SELECT doc_id, slot, value FROM sig")
def minhash_signature(t):
    return _units(t)[1].select("doc_id", F.posexplode("sig").alias("slot", "value"))


@query(f"WITH {CAND_CTE} SELECT * FROM cand")
def lsh_candidate_pairs(t):
    return similarity.candidate_pairs(_units(t)[1], CAP)


@query(f"WITH {CAND_CTE} SELECT doc_a, doc_b, round(count(*) FILTER (a.value = b.value) / 16, 6) AS est FROM cand JOIN sig a ON a.doc_id = doc_a JOIN sig b ON b.doc_id = doc_b AND b.slot = a.slot GROUP BY doc_a, doc_b")
def estimated_similarity(t):
    sigs = _units(t)[1]
    return similarity.estimated_pairs(similarity.candidate_pairs(sigs, CAP), sigs)


def _near(t) -> DataFrame:
    units, sigs = _units(t)
    return similarity.jaccard_pairs(similarity.candidate_pairs(sigs, CAP), units)


@query(f"WITH {NEAR_CTE} SELECT * FROM near")
def near_dup_pairs(t):
    return _near(t)


@once
def _members(t) -> DataFrame:
    return clusters.members(_near(t))


@query(f"WITH RECURSIVE {COMP_CTE} SELECT * FROM comp")
def near_dup_components(t):
    return _members(t)


@query(f"WITH RECURSIVE {ROLL_CTE} SELECT * FROM roll")
def cluster_rollup(t):
    return clusters.rollup(_members(t), t("documents"))


@query(f"WITH RECURSIVE {ROLL_CTE} SELECT *, row_number() OVER (ORDER BY lines_saved DESC, token_count DESC, component) AS display_id FROM roll")
def cluster_order(t):
    return clusters.ranked(clusters.rollup(_members(t), t("documents")))


_BUCKET = """b AS (SELECT component, CASE WHEN NOT bool_and(len(t) = len(t0)) THEN 'gapped' WHEN bool_and(t = t0) THEN 'identical'
  WHEN NOT bool_or(len(t) = len(t0) AND list_bool_or(list_transform(range(1, len(t) + 1), lambda i: n[i] = '<ID>' AND n0[i] = '<ID>' AND t[i] <> t0[i]))) THEN 'structural'
  WHEN bool_and(n = n0) THEN 'parameterized' ELSE 'gapped' END AS bucket FROM x JOIN (SELECT component, t AS t0, n AS n0 FROM x WHERE doc_id = component) USING (component) GROUP BY component)"""
_ANY_WORD = r"CASE WHEN regexp_matches(w, '^[0-9]+$') THEN '<NUM>' WHEN regexp_matches(w, '^[\p{L}_][\p{L}\p{N}_]*$') THEN '<ID>' ELSE w END"
_X = "x AS (SELECT component, doc_id, t, list_transform(t, lambda w: {norm}) AS n FROM (SELECT component, doc_id, {tok} AS t FROM comp JOIN documents USING (doc_id)))"


@query(f"WITH RECURSIVE {COMP_CTE}, {_X.format(norm=NORM.format(t='w'), tok=TOK)}, {_BUCKET} SELECT * FROM b")
def clone_bucket(t):
    return clusters.buckets(_members(t), t("documents"))


@query(f"WITH RECURSIVE {COMP_CTE}, {_X.format(norm=_ANY_WORD, tok=TOK)}, {_BUCKET} SELECT * FROM b")
def clone_bucket_any_word(t):
    return clusters.buckets(_members(t), t("documents"), ignore_identifiers=True)


@query(f"WITH RECURSIVE {CAT_CTE} SELECT * FROM cat")
def clone_category(t):
    return clusters.categories(_members(t), t("documents"))


@query(f"WITH RECURSIVE {CAT_CTE} SELECT roll.*, category FROM roll JOIN cat USING (component) WHERE category = 'logic' ORDER BY lines_saved DESC, token_count DESC, component LIMIT 10")
def top_clusters_filtered(t):
    of = _members(t)
    rows = clusters.rollup(of, t("documents")).join(clusters.categories(of, t("documents")), "component")
    return clusters.top(rows.where("category = 'logic'"), 10)


@query("""WITH l AS (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line, lang = 'en' AS a, source = 'src0' AS b FROM documents),
g AS (SELECT bool_or(a) AS a, bool_or(b) AS b FROM l WHERE line <> '' GROUP BY line)
SELECT count(*) FILTER (a AND b) AS "both", count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (b AND NOT a) AS only_b, round(count(*) FILTER (a AND b) / count(*) FILTER (a OR b) * 100, 6) AS jaccard_pct FROM g""")
def line_set_agreement(t):
    return clusters.line_set_agreement(t("documents"), F.col("lang") == "en", F.col("source") == "src0")


# ranges: every third document changes, in lines 1-2 and 4


_RANGES = "rg AS (SELECT doc_id, 1 AS s, 2 AS e FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 4, 4 FROM documents WHERE doc_id % 3 = 0)"


def _changed(t) -> DataFrame:
    spans = F.explode(F.array(*(F.struct(F.lit(s).alias("start"), F.lit(e).alias("end")) for s, e in ((1, 2), (4, 4)))))
    return t("documents").where("doc_id % 3 = 0").select("doc_id", spans.alias("r")).select("doc_id", "r.start", "r.end")


def _instances(t) -> DataFrame:
    return _placed(t).select("cluster", "doc_id", (F.col("first_line") + 1).alias("start"), (F.col("last_line") + 1).alias("end"))


_INST = f"{SPANS_CTE}, {_RANGES}, ins AS (SELECT DISTINCT cluster, doc_id, first_line + 1 AS s, last_line + 1 AS e FROM pl)"


@query(f"""WITH RECURSIVE {_INST}, h AS (SELECT cluster, EXISTS (SELECT 1 FROM rg WHERE rg.doc_id = ins.doc_id AND ins.s <= rg.e AND ins.e >= rg.s) AS hit FROM ins)
SELECT n_instances, n_in_diff, intersects_diff, is_new, count(*) AS n_clusters FROM (SELECT cluster, count(*) AS n_instances, count(*) FILTER (hit) AS n_in_diff, bool_or(hit) AS intersects_diff, bool_and(hit) AS is_new FROM h GROUP BY cluster) GROUP BY ALL""")
def diff_overlap_flags(t):
    flags = ranges.diff_flags(_instances(t), _changed(t))
    return flags.groupBy("n_instances", "n_in_diff", "intersects_diff", "is_new").agg(F.count("*").alias("n_clusters"))


@query(f"""WITH RECURSIVE {_INST}, d AS (SELECT DISTINCT ins.doc_id, unnest(range(greatest(ins.s, rg.s), least(ins.e, rg.e) + 1)) AS line FROM ins JOIN rg ON rg.doc_id = ins.doc_id AND ins.s <= rg.e AND ins.e >= rg.s)
SELECT c.n AS changed_lines, (SELECT count(*) FROM d) AS dup_lines, round((SELECT count(*) FROM d) / c.n * 100, 6) AS dup_pct FROM (SELECT CAST(sum(e - s + 1) AS BIGINT) AS n FROM rg) c""")
def diff_dup_pct(t):
    return ranges.diff_duplication(_instances(t), _changed(t))


_SESSION = "SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS start, CAST(floor(epoch(ts)) AS BIGINT) + 1800 AS \"end\" FROM events"
_MERGED = f"""mr AS (SELECT user_id, min(start) AS start, max("end") AS "end" FROM (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS g FROM (
  SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS o FROM ({_SESSION}))) GROUP BY user_id, g)"""


def _sessions(t) -> DataFrame:
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    return ranges.merged(t("events").where("ts is not null").select("user_id", at.alias("start"), (at + 1800).alias("end")), "user_id")


@query(f"WITH {_MERGED} SELECT * FROM mr")
def merged_ranges(t):
    """Half hours after each event, joined where they touch."""
    return _sessions(t)


@query(f"""WITH {_MERGED}, d AS (SELECT user_id, event_id AS name, CAST(floor(epoch(ts)) AS BIGINT) - 900 AS s, CAST(floor(epoch(ts)) AS BIGINT) AS e FROM events WHERE event_type = 'error')
SELECT user_id, name, string_agg(DISTINCT CAST(start AS VARCHAR) || '-' || CAST("end" AS VARCHAR), ',' ORDER BY CAST(start AS VARCHAR) || '-' || CAST("end" AS VARCHAR)) AS ranges FROM d JOIN mr USING (user_id) WHERE s <= "end" AND e >= start GROUP BY user_id, name""")
def decl_range_map(t):
    """The quarter hour before each error, with the merged ranges that it touches."""
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    decls = t("events").where("event_type = 'error'").select("user_id", F.col("event_id").alias("name"), (at - 900).alias("start"), at.alias("end"))
    return ranges.touched_declarations(decls, _sessions(t), "user_id")


# snapshots and scores


_DELTA = f"""dt AS (SELECT coalesce(o.k, n.k) AS custkey, o.s AS old_score, n.s AS new_score, coalesce(n.s, 0) - coalesce(o.s, 0) AS delta,
  CASE WHEN o.s IS NULL THEN 'added' WHEN n.s IS NULL THEN 'removed' WHEN n.s > o.s THEN 'increased' WHEN n.s < o.s THEN 'improved' ELSE 'unchanged' END AS status
  FROM (SELECT o_custkey AS k, count(*) AS s FROM orders WHERE o_orderdate < TIMESTAMP '{SPLIT_DAY}' GROUP BY 1) o
  FULL JOIN (SELECT o_custkey AS k, count(*) AS s FROM orders WHERE o_orderdate >= TIMESTAMP '{SPLIT_DAY}' GROUP BY 1) n ON o.k = n.k)"""


def _delta(t) -> DataFrame:
    day = F.lit(SPLIT_DAY).cast("timestamp")
    score = lambda rows: rows.groupBy(F.col("o_custkey").alias("custkey")).agg(F.count("*").alias("score"))
    old, new = (score(t("orders").where(c)) for c in (F.col("o_orderdate") < day, F.col("o_orderdate") >= day))
    return complexity.delta(old, new, ["custkey"])


@query(f"WITH {_DELTA} SELECT * FROM dt")
def snapshot_delta(t):
    return _delta(t)


@query(f"""WITH {_DELTA} SELECT count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'removed') AS removed, count(*) FILTER (status = 'increased') AS increased,
count(*) FILTER (status = 'improved') AS improved, count(*) FILTER (status <> 'unchanged') AS declarations_changed, CAST(sum(delta) AS BIGINT) AS net_delta FROM dt""")
def delta_summary(t):
    return complexity.summary(_delta(t))


@query(f"WITH {_DELTA} SELECT * FROM dt WHERE new_score > 8 AND status IN ('added', 'increased')")
def delta_violations(t):
    return complexity.violations(_delta(t), threshold=8, fail_on_increase=True)


_LISTS = "</?(?:ul|li|a)(?:\\s[^>]*)?>"


@query(f"""WITH e AS (SELECT page_id, i, m[i] AS tag FROM (SELECT page_id, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '{_LISTS}') AS m FROM pages))),
d AS (SELECT page_id, tag, coalesce(sum(CASE WHEN tag LIKE '</%' THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth FROM e)
SELECT page_id, CAST(sum(CASE WHEN tag LIKE '</%' THEN 0 ELSE 1 + depth END) AS BIGINT) AS score FROM d GROUP BY page_id""")
def nesting_score(t):
    """Lists, items and links of pages, each scoring one and its depth."""
    tags = t("pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(_LISTS), F.lit(0))).alias("seq", "tag"))
    closes = F.col("tag").startswith("</")
    events = tags.select("page_id", "seq", F.when(closes, 0).otherwise(1).alias("base"), (~closes).alias("structural"), F.when(closes, -1).otherwise(1).alias("opens"))
    return complexity.nesting_score(events, "page_id")


@query("""SELECT user_id, CAST(sum(CASE WHEN p IS NULL OR p <> event_type THEN 1 ELSE 0 END) AS BIGINT) AS n_runs
FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) GROUP BY user_id""")
def operator_runs(t):
    return complexity.operator_runs(t("events"), "user_id", ["ts", "event_id"], "event_type")


# the graph of parts bought together in large quantity


_EDGES = "ed AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND a.l_partkey <> b.l_partkey WHERE a.l_quantity >= 45 AND b.l_quantity >= 45)"


def _reach(brand: str, name: str) -> str:
    return f"{name} AS (SELECT p_partkey AS id FROM part WHERE p_brand = '{brand}' UNION SELECT dst FROM {name} JOIN ed ON src = id)"


_SITES = "si AS (SELECT DISTINCT l_orderkey AS site, l_partkey AS id FROM lineitem WHERE l_quantity >= 45)"
_CLASS = f"""{_EDGES}, {_reach('Brand#1', 'pr')}, {_reach('Brand#10', 'te')}, {_SITES},
hz AS (SELECT site, id, hazard FROM (SELECT site, id, id IN (SELECT id FROM pr) AS live, bool_or(id IN (SELECT id FROM pr)) OVER (PARTITION BY site) AS hazard FROM si) WHERE NOT live),
cl AS (SELECT p_partkey AS id, CASE WHEN p_partkey NOT IN (SELECT id FROM te) THEN 'pureUndead' WHEN p_size >= 45 THEN 'preserved' WHEN p_partkey IN (SELECT id FROM hz WHERE hazard) THEN 'coInvokedHazard' ELSE 'testedUndead' END AS classification
  FROM part WHERE p_partkey NOT IN (SELECT id FROM pr))"""


def _edges(t) -> DataFrame:
    rows = t("lineitem").where("l_quantity >= 45")
    a = rows.select("l_orderkey", F.col("l_linenumber").alias("i"), F.col("l_partkey").alias("src"))
    b = rows.select("l_orderkey", F.col("l_linenumber").alias("j"), F.col("l_partkey").alias("dst"))
    return a.join(b, "l_orderkey").where("i < j and src <> dst").select("src", "dst").distinct()


def _sites(t) -> DataFrame:
    return t("lineitem").where("l_quantity >= 45").select(F.col("l_orderkey").alias("site"), F.col("l_partkey").alias("id")).distinct()


def _reached(t, brand: str, edges: DataFrame | None = None) -> DataFrame:
    return graph.reachable(edges or _edges(t), t("part").where(F.col("p_brand") == brand).select(F.col("p_partkey").alias("id")))


@query(f"WITH RECURSIVE {_EDGES}, {_reach('Brand#1', 'r')} SELECT id AS part_id FROM r")
def reach_production(t):
    return _reached(t, "Brand#1").withColumnRenamed("id", "part_id")


@query(f"WITH RECURSIVE {_EDGES}, {_reach('Brand#10', 'r')} SELECT id AS part_id FROM r")
def reach_test(t):
    return _reached(t, "Brand#10").withColumnRenamed("id", "part_id")


@query(f"WITH RECURSIVE {_CLASS} SELECT id AS part_id, classification, CASE classification WHEN 'pureUndead' THEN 'delete' WHEN 'coInvokedHazard' THEN 'manualRefactorHazard' ELSE 'deleteWithOrphanTests' END AS action FROM cl WHERE classification <> 'preserved'")
def dead_classification(t):
    """Parts that Brand#1 doesn't reach; Brand#10 is the tests, sizes of 45 on are test support."""
    edges, parts = cut(_edges(t)), t("part").select(F.col("p_partkey").alias("id"), "p_size")
    live, tested = _reached(t, "Brand#1", edges), _reached(t, "Brand#10", edges)
    out = graph.classified(parts.select("id"), live, tested, parts.where("p_size >= 45").select("id"), _sites(t))
    return out.withColumnRenamed("id", "part_id")


@query(f"WITH RECURSIVE {_CLASS} SELECT classification, count(*) AS n FROM cl WHERE classification <> 'preserved' GROUP BY classification")
def finding_counts(t):
    return dead_classification(t).groupBy("classification").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {_EDGES}, {_reach('Brand#1', 'pr')}, {_SITES}, x AS (SELECT site, id, id IN (SELECT id FROM pr) AS live, bool_or(id IN (SELECT id FROM pr)) OVER (PARTITION BY site) AS hazard FROM si) SELECT site, id AS part_id, hazard FROM x WHERE NOT live")
def hazard_sites(t):
    return graph.hazards(_sites(t), _reached(t, "Brand#1")).withColumnRenamed("id", "part_id")


@query(f"""WITH RECURSIVE {_EDGES}, {_reach('Brand#1', 'pr')}, ty AS (SELECT p_partkey AS id, p_type AS f FROM part)
SELECT id AS part_id FROM pr JOIN part ON p_partkey = id WHERE p_size >= 5 AND id NOT IN (SELECT dst FROM ed JOIN ty a ON a.id = src JOIN ty b ON b.id = dst WHERE a.f <> b.f)
AND id NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 48)""")
def private_candidates(t):
    """Reached parts, not exported ones of size under 5, that only parts of their own type lead to, untested."""
    edges = cut(_edges(t))
    nodes = t("part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("file"), (F.col("p_size") < 5).alias("exported"))
    tests = t("lineitem").where("l_returnflag = 'R' and l_quantity >= 48").select(F.col("l_partkey").alias("id"))
    return graph.private_candidates(nodes, _reached(t, "Brand#1", edges), edges, tests).withColumnRenamed("id", "part_id")


@query("""WITH n AS (SELECT s_suppkey AS id, s_nationkey AS f FROM supplier), g AS (SELECT n_regionkey AS grp, n_nationkey AS f FROM nation)
SELECT DISTINCT a.id AS src, b.id AS dst FROM g ga JOIN n a ON a.f = ga.f JOIN g gb ON gb.grp = ga.grp AND gb.f <> ga.f JOIN n b ON b.f = gb.f""")
def conditional_group_edges(t):
    """Suppliers are declarations, nations files, regions their conditional groups."""
    nodes = t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("file"))
    groups = t("nation").select(F.col("n_regionkey").alias("grp"), F.col("n_nationkey").alias("file"))
    return graph.group_edges(nodes, groups)


@query(f"""WITH RECURSIVE {_EDGES}, s AS (SELECT p_partkey AS parent, p_partkey + 1 AS child FROM part WHERE p_size = 7 AND p_partkey + 1 IN (SELECT p_partkey FROM part)),
es AS (SELECT * FROM ed UNION SELECT * FROM s), r AS (SELECT p_partkey AS id FROM part WHERE p_brand = 'Brand#1' UNION SELECT dst FROM r JOIN es ON src = id) SELECT id FROM r""")
def sealed_expansion(t):
    """Parts of size 7 are sealed, the next part is their subtype."""
    parts = t("part").select(F.col("p_partkey").alias("parent"), "p_size")
    children = parts.select(F.col("parent").alias("child"))
    sealed = parts.where("p_size = 7").select("parent", (F.col("parent") + 1).alias("child")).join(children, "child", "left_semi")
    return _reached(t, "Brand#1", graph.with_sealed(_edges(t), sealed.select("parent", "child")))


# slices of users' logs: place in time order, event type as variable, large values are writes


_LOG = "lg AS (SELECT user_id AS unit, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS \"at\", event_type AS var, value >= 75 AS w FROM events)"
_SLICE = """sl AS (SELECT unit, slice, slice * 20 + 5 AS first, slice * 20 + 14 AS last FROM (SELECT unit, n, unnest(range(0, n // 20 + 1)) AS slice FROM (SELECT unit, count(*) AS n FROM lg GROUP BY unit)) WHERE slice * 20 + 5 <= n)"""
_USE = f"{_LOG}, {_SLICE}, us AS (SELECT lg.*, d.declared, slice, first, last FROM lg JOIN (SELECT unit, var, min(\"at\") AS declared FROM lg GROUP BY unit, var) d USING (unit, var) JOIN sl USING (unit))"


def _log(t) -> DataFrame:
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t("events").select(F.col("user_id").alias("unit"), at.alias("at"), F.col("event_type").alias("var"), (F.col("value") >= 75).alias("is_write"), F.lit(False).alias("is_decl"))


def _parts(t, step: int) -> DataFrame:
    """(unit, n, i): for each user, i from 0 as often as ``step`` places begin in a log of n."""
    n = t("events").groupBy(F.col("user_id").alias("unit")).agg(F.count("*").cast("int").alias("n"))
    return n.select("unit", "n", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / step).cast("int"))).alias("i"))


def _slices(t) -> DataFrame:
    """Ten of every twenty places of a log, as far as it goes."""
    rows = _parts(t, 20).select("unit", "n", F.col("i").alias("slice"), (F.col("i") * 20 + 5).alias("first"), (F.col("i") * 20 + 14).alias("last"))
    return rows.where("first <= n").drop("n")


@query(f"WITH {_USE} SELECT unit, slice, var, bool_or(w) AS is_mutated FROM us WHERE \"at\" BETWEEN first AND last AND declared < first GROUP BY unit, slice, var")
def slice_inputs(t):
    return dataflow.inputs(_log(t), _slices(t))


@query(f"WITH {_USE} SELECT unit, slice, var, min(\"at\") AS first_mutation FROM us WHERE \"at\" BETWEEN first AND last AND w AND declared < first GROUP BY unit, slice, var")
def slice_mutations(t):
    return dataflow.mutations(_log(t), _slices(t))


_OUT = """SELECT DISTINCT unit, slice, var FROM us a WHERE "at" BETWEEN first AND last AND (w OR declared >= first) AND EXISTS (SELECT 1 FROM us b WHERE (b.unit, b.slice, b.var) = (a.unit, a.slice, a.var) AND b."at" > b.last AND NOT b.w)"""


@query(f"WITH {_USE} {_OUT}")
def slice_outputs(t):
    return dataflow.outputs(_log(t), _slices(t))


@query(f"""WITH {_USE} {_OUT} UNION SELECT DISTINCT unit, slice, var FROM us a WHERE "at" BETWEEN first AND last AND w AND EXISTS (
SELECT 1 FROM us b WHERE (b.unit, b.slice, b.var) = (a.unit, a.slice, a.var) AND NOT b.w AND b.slice % 3 < 2 AND b."at" BETWEEN b.slice // 3 * 60 + 2 AND b.slice // 3 * 60 + 50 AND b.declared < b.slice // 3 * 60 + 4)""")
def slice_outputs_in_loop(t):
    """Of every sixty places, those from 2 to 50 are a loop."""
    loops = _parts(t, 60).select("unit", (F.col("i") * 60 + 2).alias("loop_first"), (F.col("i") * 60 + 50).alias("loop_last"), (F.col("i") * 60 + 4).alias("carry"))
    return dataflow.outputs(_log(t), _slices(t), loops)


_JUMP = "jp AS (SELECT unit, \"at\", var AS kind, CASE WHEN var = 'error' THEN NULL ELSE \"at\" + 4 END AS target FROM lg WHERE var IN ('error', 'signup'))"


def _jumps(t) -> DataFrame:
    target = F.when(F.col("var") != "error", F.col("at") + 4)
    return _log(t).where("var in ('error', 'signup')").select("unit", "at", F.col("var").alias("kind"), target.alias("target"))


@query(f"WITH {_LOG}, {_SLICE}, {_JUMP} SELECT unit, slice, \"at\", kind FROM jp JOIN sl USING (unit) WHERE \"at\" BETWEEN first AND last AND (target IS NULL OR target < first OR target > last)")
def slice_escapes(t):
    """Errors leave for good, sign-ups jump four places on."""
    return dataflow.escapes(_jumps(t), _slices(t))


@query(f"WITH {_LOG}, {_SLICE}, {_JUMP} SELECT unit, slice, NOT EXISTS (SELECT 1 FROM jp WHERE jp.unit = sl.unit AND \"at\" BETWEEN first AND last AND (target IS NULL OR target < first OR target > last)) AS is_clean FROM sl")
def slice_extractable(t):
    return dataflow.extractable(_slices(t), dataflow.escapes(_jumps(t), _slices(t)))


# paths, suppression, cache


_ROLES = {"publicLib": "**.example.com/en/**", "internalSrc": "**.example.com/**", "test": "**.example.net/**"}


def _case(col: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({col}, '{globs.glob_regex(g)}') THEN '{r}'" for r, g in _ROLES.items()) + " ELSE 'other' END"


@query(f"SELECT {_case('url')} AS role, count(*) AS n FROM pages WHERE NOT regexp_matches(url, '{globs.glob_regex('**page=2**')}') GROUP BY 1")
def glob_role_filter(t):
    """Pages by the first glob that their address fits, without excluded ones."""
    role = F.lit("other")
    for r, g in reversed(_ROLES.items()):
        role = F.when(F.col("url").rlike(globs.glob_regex(g)), r).otherwise(role)
    return t("pages").where(~globs.any_glob(F.col("url"), ["**page=2**"])).groupBy(role.alias("role")).agg(F.count("*").alias("n"))


_QUIET = "(?:^|[^a-z])the thing(?:[^a-z]|$)|(?:^|[^a-z])of(?:[^a-z]|$)"


@query(f"""WITH f AS (SELECT conv_id, bool_or(role = 'system' AND regexp_matches(text, '{_QUIET}')) AS whole FROM conversations GROUP BY conv_id),
r AS (SELECT conv_id, turn, lag(regexp_matches(text, '{_QUIET}')) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
SELECT conv_id, turn FROM r JOIN f USING (conv_id) WHERE whole OR coalesce(before, false)""")
def suppressed_rows(t):
    """Turns of conversations whose system text says so, and turns right after one that does."""
    from pyspark.sql import Window

    c = t("conversations").withColumn("mark", F.col("text").rlike(_QUIET))
    whole = F.max((F.col("role") == "system") & F.col("mark")).over(Window.partitionBy("conv_id"))
    before = F.coalesce(F.lag("mark").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(False))
    return c.select("conv_id", "turn", whole.alias("w"), before.alias("b")).where("w or b").select("conv_id", "turn")


@query("""SELECT coalesce(d.doc_id, c.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'prune' WHEN c.doc_id IS NULL OR c.h <> d.h THEN 'extract' ELSE 'hit' END AS action
FROM (SELECT doc_id, md5(coalesce(text, '')) AS h FROM documents) d FULL JOIN (SELECT CASE WHEN doc_id % 5 = 0 THEN -doc_id - 1 ELSE doc_id END AS doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN 'old' ELSE coalesce(text, '') END) AS h FROM documents WHERE doc_id % 2 = 0) c ON c.doc_id = d.doc_id""")
def cache_work_list(t):
    """What an extraction with a cache of earlier texts has to do: hit, extract or prune."""
    docs = t("documents").select(F.col("doc_id").alias("path"), cache.content_hash(F.col("text")).alias("content_hash"))
    old = t("documents").where("doc_id % 2 = 0").select(
        F.when(F.col("doc_id") % 5 == 0, -F.col("doc_id") - 1).otherwise(F.col("doc_id")).alias("path"),
        cache.content_hash(F.when(F.col("doc_id") % 3 == 0, F.lit("old")).otherwise(F.col("text"))).alias("content_hash"),
    )
    return cache.work_list(docs, old).withColumnRenamed("path", "doc_id")
