"""Queries for sequence alignment and what is built on it."""

from pyspark.sql import functions as F

from spanaccord import settings
from spanaccord.operators import align as A, audit as Q, reshape as P, tokens as TK
from spanaccord.operators.scan import highest, lead, lowest, number, scan
from spanaccord.operators.scoring import DEVOICED_VOWELS, VOICED_VOWELS
from spanaccord.plans import bindings as B
from spanaccord.plans.oracle import ALN, HYP, MAP, UNITS, words
from spanaccord.plans.registry import query

SQUEEZE = 200000.0
GRID = [dict(A.DEFAULT, config=f"far{round(1000 * f)}", far=f) for f in (0.10, 0.15, 0.20)]
#: seconds by which a dense window is wider than its units
MARGIN = 0.2
#: reference labels made of several, and the parts that the hypothesis has in their place
PLANTED = [("signup", 5, 1, ("signup", "click")), ("purchase", 7, 2, ("purchase", "click", "error"))]

#: columns of a unit that its alignment and the other side are made of
UNIT = ["file_id", "ipu_id", "event_id", "unit_id", "t_start", "t_end", "label", "phone_class", "excluded_reason", "boundary_source_start", "boundary_source_end"]


def sides(spark, sf, squeeze=None):
    """Evaluable reference and hypothesis units; ``squeeze`` makes the time axis dense."""
    u = settings.cut(B.windowed_units(spark, sf))       # read several times below
    r = P.evaluable(u)
    if squeeze:
        u = u.withColumn("t_start", F.col("t_start") / squeeze).withColumn("t_end", F.col("t_end") / squeeze)
        r = P.evaluable(u)
    # some reference units are made of two labels
    r = r.withColumn("label_source", F.when((F.col("label") == "signup") & (F.col("event_id") % 5 == 1), "signup+click").otherwise(F.col("label")))
    return r, B.hyp_units(spark, sf, u)


@query("a01_align_windows", """WITH e AS (SELECT *, CASE WHEN label = 'signup' AND event_id % 5 = 1 THEN 'signup+click' ELSE label END AS src FROM ref WHERE excluded_reason IS NULL AND boundary_source_start = 'measured' AND boundary_source_end = 'measured'),
  w AS (SELECT file_id, ipu_id, min(t_start) AS a, max(t_end) AS b FROM e GROUP BY 1, 2),
  h AS (SELECT h.*, w.ipu_id FROM hyp h JOIN w ON w.file_id = h.file_id AND h.t_end > a AND h.t_start < b AND ((a <= (h.t_start + h.t_end) / 2 AND (h.t_start + h.t_end) / 2 < b) OR (h.t_start >= a AND h.t_end <= b))),
  p AS (SELECT e.file_id, e.ipu_id, e.unit_id AS rid, h.unit_id AS hid, e.phone_class, e.src, h.label AS hlab, (h.t_start - e.t_start) * 1e3 AS onset_error_ms, (h.t_end - e.t_end) * 1e3 AS offset_error_ms FROM e JOIN h ON h.event_id = e.event_id AND h.ipu_id = e.ipu_id AND abs(h.t_start - e.t_start) <= 0.15 AND abs(h.t_end - e.t_end) <= 0.15)
  SELECT file_id, ipu_id, rid AS ref_unit_id, hid AS hyp_unit_id, phone_class, CASE WHEN EXISTS (SELECT 1 FROM lm WHERE lm.source_label = src AND lm.machine_label = hlab) THEN 'displacement' ELSE 'substitution' END AS error_type, onset_error_ms, offset_error_ms FROM p
  UNION ALL SELECT file_id, ipu_id, unit_id, '', phone_class, 'omission', NULL, NULL FROM e WHERE unit_id NOT IN (SELECT rid FROM p) UNION ALL SELECT file_id, ipu_id, NULL, unit_id, phone_class, 'insertion', NULL, NULL FROM h WHERE (unit_id, ipu_id) NOT IN (SELECT (hid, ipu_id) FROM p)""",
       "onset_error_ms offset_error_ms", [UNITS, HYP, MAP], digits=4)
def a01(spark, sf):
    r, h = sides(spark, sf)
    a = A.align_windows(r, h, B.label_map(spark))
    return a.select("file_id", "ipu_id", "ref_unit_id", F.array_join("hyp_unit_ids", ";").alias("hyp_unit_id"), "phone_class", "error_type", "onset_error_ms", "offset_error_ms")


def dense_sides(spark, sf):
    """Dense units with window times, and labels of two and three parts for which the other side has a unit each."""
    u = B.windowed_units(spark, sf).withColumn("t_start", F.col("t_start") / SQUEEZE).withColumn("t_end", F.col("t_end") / SQUEEZE)
    u = scan(u, ["file_id", "ipu_id"], ["t_start"], {"_from": lowest("t_start"), "_to": highest("t_end")})
    u = settings.kept(u.select(*UNIT, (F.col("_from") - MARGIN).alias("ipu_start"), (F.col("_to") + MARGIN).alias("ipu_end")), "units")     # read several times below
    label = lambda c, parts: F.when((F.col("label") == c[0]) & (F.col("event_id") % c[1] == c[2]), parts)
    source = F.coalesce(*[label(c, F.lit("+".join(c[3]))) for c in PLANTED], F.col("label"))
    r = P.evaluable(u).where("file_id is not null").withColumn("label_source", source)
    parts = F.coalesce(*[F.when(F.col("unit_id").startswith("h"), label(c, F.array(*map(F.lit, c[3])))) for c in PLANTED], F.array("label"))
    h = B.hyp_units(spark, sf, u).withColumn("_parts", parts)
    h = h.select("file_id", "event_id", "unit_id", "t_start", "t_end", "phone_class", F.size("_parts").alias("_k"), F.posexplode("_parts").alias("_q", "label"))
    at = lambda q: F.col("t_start") + (F.col("t_end") - F.col("t_start")) * q / F.col("_k")
    name = F.when(F.col("_k") > 1, F.concat("unit_id", F.lit("."), F.col("_q").cast("string"))).otherwise(F.col("unit_id"))
    return r, h.select("file_id", "event_id", name.alias("unit_id"), at(F.col("_q")).alias("t_start"), at(F.col("_q") + 1).alias("t_end"), "label", "phone_class")


def _case(parts, other):
    return "CASE " + " ".join(f"WHEN label = '{c}' AND event_id % {n} = {k} THEN {parts(p)}" for c, n, k, p in PLANTED) + f" ELSE {other} END"


def dense_sql(configs) -> str:
    """The whole table of every window row by row, then the steps back from its end."""
    source = _case(lambda p: f"'{'+'.join(p)}'", "label")
    parts = f"CASE WHEN unit_id NOT LIKE 'h%' THEN [label] ELSE {_case(lambda p: str(list(p)), '[label]')} END"
    return f"""WITH RECURSIVE {UNITS},
  sq AS (SELECT * REPLACE (t_start / {SQUEEZE}::DOUBLE AS t_start, t_end / {SQUEEZE}::DOUBLE AS t_end) FROM ref),
  {HYP.replace("FROM ref", "FROM sq")}, {MAP},
  spans AS (SELECT file_id, ipu_id, min(t_start) - {MARGIN}::DOUBLE AS a, max(t_end) + {MARGIN}::DOUBLE AS b FROM sq GROUP BY 1, 2),
  hyp1 AS (SELECT *, {parts} AS p FROM hyp), hyp2 AS (SELECT file_id, unit_id, t_start, t_end, phone_class, p, unnest(range(0, len(p))) AS q FROM hyp1),
  h AS (SELECT file_id, CASE WHEN len(p) > 1 THEN unit_id || '.' || q ELSE unit_id END AS unit_id, t_start + (t_end - t_start) * q / len(p) AS t_start, t_start + (t_end - t_start) * (q + 1) / len(p) AS t_end, p[q + 1] AS label, phone_class FROM hyp2),
  r AS (SELECT file_id, ipu_id, unit_id, t_start, t_end, {source} AS src, phone_class, row_number() OVER (PARTITION BY file_id, ipu_id ORDER BY t_start, unit_id) AS i FROM sq
    WHERE excluded_reason IS NULL AND boundary_source_start = 'measured' AND boundary_source_end = 'measured' AND file_id IN (SELECT file_id FROM h)),
  hw AS (SELECT h.*, w.ipu_id, row_number() OVER (PARTITION BY h.file_id, w.ipu_id ORDER BY t_start, unit_id) AS j FROM h JOIN (SELECT * FROM spans SEMI JOIN r USING (file_id, ipu_id)) w ON w.file_id = h.file_id
    AND t_end > a AND t_start < b AND ((a <= (t_start + t_end) / 2 AND (t_start + t_end) / 2 < b) OR (t_start >= a AND t_end <= b))),
  cfg AS (SELECT * FROM (VALUES {", ".join(f"('{c['config']}', {c['far']}::DOUBLE)" for c in configs)}) v(config, far)),
  sizes AS (SELECT config, far, file_id, ipu_id, n, coalesce(m, 0) AS m FROM (SELECT file_id, ipu_id, count(*) AS n FROM r GROUP BY 1, 2) LEFT JOIN (SELECT file_id, ipu_id, count(*) AS m FROM hw GROUP BY 1, 2) USING (file_id, ipu_id), cfg),
  cells AS (SELECT config, file_id, ipu_id, r.i, e.j, CASE WHEN abs(e.t_start - r.t_start) <= far AND abs(e.t_end - r.t_end) <= far THEN CASE WHEN EXISTS (SELECT 1 FROM lm WHERE source_label = src AND machine_label = e.label) THEN 2 ELSE -1 END END AS one,
    CASE WHEN len(string_split(src, '+')) BETWEEN 2 AND 3 AND abs(f.t_start - r.t_start) <= far AND abs(e.t_end - r.t_end) <= far
      AND (SELECT count(DISTINCT g.j) FROM hw g, lm WHERE g.file_id = r.file_id AND g.ipu_id = r.ipu_id AND g.j BETWEEN f.j AND e.j AND source_label = string_split(src, '+')[g.j - f.j + 1] AND machine_label = g.label) = len(string_split(src, '+')) THEN len(string_split(src, '+')) ELSE 0 END AS many
    FROM sizes JOIN r USING (file_id, ipu_id) JOIN hw e USING (file_id, ipu_id) LEFT JOIN hw f ON f.file_id = r.file_id AND f.ipu_id = r.ipu_id AND f.j = e.j - len(string_split(src, '+')) + 1),
  lists AS (SELECT config, file_id, ipu_id, i, list(one ORDER BY j) AS o, list(many ORDER BY j) AS mu FROM cells GROUP BY ALL),
  rows AS (SELECT s.config, s.file_id, s.ipu_id, r.i, coalesce(o, []) AS o, coalesce(mu, []) AS mu FROM sizes s JOIN r USING (file_id, ipu_id) LEFT JOIN lists l ON l.config = s.config AND l.file_id = s.file_id AND l.ipu_id = s.ipu_id AND l.i = r.i),
  dp AS (SELECT config, file_id, ipu_id, 0::BIGINT AS i, list_transform(range(0, m + 1), lambda j: -2 * j) AS s FROM sizes
    UNION ALL SELECT config, file_id, ipu_id, i, list_transform(range(0, len(best)), lambda j: list_max(list_transform(range(0, j + 1), lambda q: best[q + 1] - 2 * (j - q)))) FROM
      (SELECT dp.config, dp.file_id, dp.ipu_id, rows.i, list_transform(range(0, len(s)), lambda j: greatest(s[j + 1] - 2, s[j] + o[j], CASE WHEN mu[j] > 0 THEN s[j + 1 - mu[j]] + 2 * mu[j] END)) AS best
       FROM dp JOIN rows ON rows.config = dp.config AND rows.file_id = dp.file_id AND rows.ipu_id = dp.ipu_id AND rows.i = dp.i + 1)),
  walk AS (SELECT config, file_id, ipu_id, n::BIGINT AS i, m::BIGINT AS j, NULL::BIGINT AS ri, NULL::BIGINT AS hj, NULL::BIGINT AS k FROM sizes
    UNION ALL SELECT config, file_id, ipu_id, CASE WHEN k >= 0 THEN i - 1 ELSE i END, j - abs(k), CASE WHEN k >= 0 THEN i END, j, k FROM
      (SELECT t.config, t.file_id, t.ipu_id, t.i, t.j, CASE WHEN t.i = 0 THEN -1 WHEN t.j > 0 AND mu[t.j] > 0 AND a.s[t.j + 1] = b.s[t.j + 1 - mu[t.j]] + 2 * mu[t.j] THEN mu[t.j]
         WHEN t.j > 0 AND o[t.j] IS NOT NULL AND a.s[t.j + 1] = b.s[t.j] + o[t.j] THEN 1 WHEN a.s[t.j + 1] = b.s[t.j + 1] - 2 THEN 0 ELSE -1 END::BIGINT AS k
       FROM walk t LEFT JOIN dp a ON a.config = t.config AND a.file_id = t.file_id AND a.ipu_id = t.ipu_id AND a.i = t.i LEFT JOIN dp b ON b.config = t.config AND b.file_id = t.file_id AND b.ipu_id = t.ipu_id AND b.i = t.i - 1
         LEFT JOIN rows x ON x.config = t.config AND x.file_id = t.file_id AND x.ipu_id = t.ipu_id AND x.i = t.i WHERE t.i > 0 OR t.j > 0)),
  found AS (SELECT w.config, w.file_id, w.ipu_id, r.unit_id AS ref_unit_id, coalesce(r.phone_class, f.phone_class) AS phone_class, greatest(abs(w.k), 0) AS n_hyp_units,
    CASE WHEN w.k = 0 THEN '' ELSE (SELECT string_agg(g.unit_id, ';' ORDER BY g.j) FROM hw g WHERE g.file_id = w.file_id AND g.ipu_id = w.ipu_id AND g.j > w.hj - abs(w.k) AND g.j <= w.hj) END AS hyp_unit_ids,
    CASE WHEN w.ri IS NULL THEN 'insertion' WHEN w.k = 0 THEN 'omission' WHEN w.k > 1 THEN 'displacement' WHEN EXISTS (SELECT 1 FROM lm WHERE source_label = src AND machine_label = f.label) THEN 'displacement' ELSE 'substitution' END AS error_type,
    (f.t_start - r.t_start) * 1000 AS onset_error_ms, (l.t_end - r.t_end) * 1000 AS offset_error_ms
    FROM walk w LEFT JOIN r ON r.file_id = w.file_id AND r.ipu_id = w.ipu_id AND r.i = w.ri LEFT JOIN hw f ON w.k <> 0 AND f.file_id = w.file_id AND f.ipu_id = w.ipu_id AND f.j = w.hj - abs(w.k) + 1
      LEFT JOIN hw l ON w.k <> 0 AND l.file_id = w.file_id AND l.ipu_id = w.ipu_id AND l.j = w.hj WHERE w.k IS NOT NULL)
"""


@query("a01_align_dense", dense_sql([A.DEFAULT]) + "SELECT phone_class, error_type, n_hyp_units, count(*) AS n, avg(abs(onset_error_ms)) AS mean_onset FROM found GROUP BY ALL", "mean_onset", big="n_hyp_units")
def a01b(spark, sf):
    r, h = dense_sides(spark, sf)
    a = A.align_windows(r, h, B.label_map(spark))
    return a.groupBy("phone_class", "error_type", "n_hyp_units").agg(F.count("*").alias("n"), F.avg(F.abs("onset_error_ms")).alias("mean_onset"))


@query("a01_align_dense_rows", dense_sql([A.DEFAULT]) + "SELECT file_id, ipu_id, ref_unit_id, hyp_unit_ids, phone_class, error_type, onset_error_ms, offset_error_ms FROM found", "onset_error_ms offset_error_ms", digits=4)
def a01c(spark, sf):
    r, h = dense_sides(spark, sf)
    a = A.align_windows(r, h, B.label_map(spark))
    return a.select("file_id", "ipu_id", "ref_unit_id", F.array_join("hyp_unit_ids", ";").alias("hyp_unit_ids"), "phone_class", "error_type", "onset_error_ms", "offset_error_ms")


@query("a02_align_sweep", dense_sql(GRID) + "SELECT config, error_type, n_hyp_units, count(*) AS n FROM found GROUP BY ALL", big="n_hyp_units")
def a02(spark, sf):
    r, h = dense_sides(spark, sf)
    a = A.align_windows(r, h, B.label_map(spark), GRID)
    return a.groupBy("config", "error_type", "n_hyp_units").agg(F.count("*").alias("n"))


_RATES = ", ".join(f"100.0 * count(*) FILTER (error_type = '{t}') / count(*) AS pct_{t}" for t in ("displacement", "substitution", "omission", "insertion"))
_WITHIN = [(f"{b}_within{t}", f"100.0 * count(*) FILTER (error_type IN ('displacement', 'substitution') AND abs({b}_error_ms) <= {t}) / nullif(count(*) FILTER (error_type IN ('displacement', 'substitution')), 0)") for b in ("onset", "offset") for t in (10, 20)]


@query("q06_sweep_summary", dense_sql(GRID) + f"SELECT config, count(*) AS n, {_RATES}, " + ", ".join(f"{e} AS {n}" for n, e in _WITHIN) + " FROM found GROUP BY 1",
       "pct_displacement pct_substitution pct_omission pct_insertion " + " ".join(n for n, _ in _WITHIN))
def q06(spark, sf):
    r, h = dense_sides(spark, sf)
    return Q.sweep_summary(A.align_windows(r, h, B.label_map(spark), GRID))


def name_pairs(spark, sf, letters=True):
    """Letters of words of one text beside the word that follows them; plain words only, or all."""
    w = scan(B.words(spark, sf, "benchmark", "item_id"), ["doc"], ["pos"], {"nxt": lead("word")})
    w = w.where("nxt is not null and word rlike '^[a-z]+$' and nxt rlike '^[a-z]+$'" if letters else "nxt is not null")
    return w.select("word", "nxt", F.split("word", "").alias("a"), F.split("nxt", "").alias("b")).distinct()


def _sound_sql(x, y):
    vowels = ", ".join(f"'{v}'" for v in sorted(A.ALL_VOWELS))
    high = lambda c: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in A.HIGH_BASE.items()) + " END"
    return f"CASE WHEN {x} = {y} THEN 0 WHEN ({x} IN ({vowels})) <> ({y} IN ({vowels})) THEN 90 WHEN {high(x)} = {high(y)} THEN 4 ELSE 10 END"


def edit_ctes(keys: str, cost) -> str:
    """Edit tables of pairs (keys, a, b) row by row, in tenths, then the steps back from their ends (walk)."""
    k = [x.strip() for x in keys.split(",")]
    on = lambda x, y: " AND ".join(f"{x}.{c} = {y}.{c}" for c in k)
    of = lambda t: ", ".join(f"{t}.{c}" for c in k)
    return f"""dp AS (SELECT {keys}, 0::BIGINT AS i, list_transform(range(0, len(b) + 1), lambda j: 10 * j) AS s FROM pairs
    UNION ALL SELECT {keys}, i, list_transform(range(0, len(best)), lambda j: list_min(list_transform(range(0, j + 1), lambda q: best[q + 1] + 10 * (j - q)))) FROM
      (SELECT {of("dp")}, dp.i + 1 AS i, list_transform(range(0, len(s)), lambda j: least(s[j + 1] + 10, s[j] + {cost("a[dp.i + 1]", "b[j]")})) AS best FROM dp JOIN pairs USING ({keys}) WHERE dp.i < len(a))),
  walk AS (SELECT {keys}, len(a) AS i, len(b) AS j, NULL::BIGINT AS pi, NULL::BIGINT AS pj, NULL::VARCHAR AS kind FROM pairs
    UNION ALL SELECT {keys}, CASE WHEN kind = 'added' THEN i ELSE i - 1 END, CASE WHEN kind = 'left out' THEN j ELSE j - 1 END, i, j, kind FROM
      (SELECT {of("t")}, t.i, t.j, CASE WHEN t.i > 0 AND t.j > 0 AND x.s[t.j + 1] = y.s[t.j] + {cost("a[t.i]", "b[t.j]")} THEN 'paired' WHEN t.i > 0 AND x.s[t.j + 1] = y.s[t.j + 1] + 10 THEN 'left out' ELSE 'added' END AS kind
       FROM walk t JOIN pairs USING ({keys}) JOIN dp x ON {on("x", "t")} AND x.i = t.i LEFT JOIN dp y ON {on("y", "t")} AND y.i = t.i - 1 WHERE t.i > 0 OR t.j > 0))"""


def _unit_sql(x, y):
    return f"CASE WHEN {x} = {y} THEN 0 ELSE 10 END"


def edit_sql(cost) -> str:
    return f"""WITH RECURSIVE {words("benchmark", "item_id")},
  pairs AS (SELECT DISTINCT word, nxt, string_split(word, '') AS a, string_split(nxt, '') AS b FROM (SELECT word, lead(word) OVER (PARTITION BY doc ORDER BY pos) AS nxt FROM words) WHERE nxt IS NOT NULL),
  {edit_ctes("word, nxt", cost)},
  found AS (SELECT p.word, p.nxt, (SELECT s[len(p.b) + 1] FROM dp WHERE dp.word = p.word AND dp.nxt = p.nxt AND dp.i = len(p.a)) / 10.0::DOUBLE AS cost,
    array_to_string(list(CASE WHEN kind = 'paired' THEN pj - 1 ELSE -1 END ORDER BY pi) FILTER (kind <> 'added'), ',') AS "left", array_to_string(list(CASE WHEN kind = 'added' THEN pi ELSE -1 END ORDER BY pj) FILTER (kind <> 'left out'), ',') AS gap_of,
    coalesce(string_agg((pi - 1) || ':' || (pj - 1), ';' ORDER BY pi) FILTER (kind = 'paired' AND a[pi] = b[pj]), '') AS pairs FROM walk w JOIN pairs p USING (word, nxt) WHERE kind IS NOT NULL GROUP BY p.word, p.nxt, p.a, p.b)
"""


@query("a03_align_classes", "SELECT DISTINCT word, nxt, levenshtein(word, nxt)::DOUBLE AS cost FROM (SELECT word, lead(word) OVER (PARTITION BY doc ORDER BY pos) AS nxt FROM words) WHERE regexp_full_match(word, '[a-z]+') AND regexp_full_match(nxt, '[a-z]+')", ctes=[words("benchmark", "item_id")])
def a03(spark, sf):
    return A.align_classes(name_pairs(spark, sf), "a", "b").select("word", "nxt", "cost")


@query("a03_align_pairs", edit_sql(_unit_sql) + "SELECT word, nxt, cost, pairs FROM found", "cost")
def a03b(spark, sf):
    e = A.align_classes(name_pairs(spark, sf, letters=False), "a", "b")
    return e.select("word", "nxt", "cost", F.array_join(F.transform("pairs", lambda p: F.concat(p["i"].cast("string"), F.lit(":"), p["j"].cast("string"))), ";").alias("pairs"))


@query("a04_align_prons", edit_sql(_sound_sql) + 'SELECT word, nxt, cost, "left", gap_of FROM found', "cost")
def a04(spark, sf):
    e = A.align_prons(name_pairs(spark, sf, letters=False), "a", "b")
    return e.select("word", "nxt", "cost", F.array_join("left", ",").alias("left"), F.array_join("gap_of", ",").alias("gap_of"))


@query("a05_classify_pairs", """SELECT error_type, t, count(*) AS n FROM (SELECT a.error_type, CASE WHEN ref_unit_id IS NULL THEN 'insertion' WHEN n_hyp_units = 0 THEN 'omission' WHEN n_hyp_units > 1 THEN 'displacement'
  WHEN EXISTS (SELECT 1 FROM lm WHERE source_label = a.label AND machine_label = h.label) THEN 'displacement' ELSE 'substitution' END AS t FROM aln a LEFT JOIN (SELECT unit_id, label FROM hyp) h ON h.unit_id = a.hyp_unit_ids[1]) GROUP BY 1, 2""", ctes=[UNITS, HYP, ALN, MAP])
def a05(spark, sf):
    from spanaccord.operators.joins import compatible

    r = B.ref_units(spark, sf)
    h = B.hyp_units(spark, sf, r).select(F.col("unit_id").alias("h1"), F.col("label").alias("hyp_label"))
    a = B.alignment(spark, sf, r).withColumn("h1", F.get("hyp_unit_ids", F.lit(0))).withColumnRenamed("error_type", "given").join(h, "h1", "left")
    c = compatible(a, B.label_map(spark), "label", "hyp_label")
    t = A.classify_pairs(c, "ref_unit_id", "n_hyp_units", F.col("compatible"))
    return t.groupBy(F.col("given").alias("error_type"), F.col("error_type").alias("t")).agg(F.count("*").alias("n"))


@query("a06_pair_deviations", """WITH w AS (SELECT file_id, ipu_id, count(*) AS n_ref, count(*) FILTER (event_id % 17 <> 0 AND event_id % 23 <> 0 AND NOT (label = 'view' AND event_id % 2 = 0)) AS n_ok FROM ref GROUP BY 1, 2 HAVING count(*) = 1)
  SELECT w.file_id, w.ipu_id, 2 AS n_devs, 1.0::DOUBLE AS coverage, 1e3 * (abs((event_id % 11 - 5) * 0.0073::DOUBLE + f) + abs((event_id % 13 - 6) * 0.0089::DOUBLE + f)) / 2 AS dev_word_ms
  FROM w JOIN (SELECT *, CASE WHEN event_id % 19 = 0 THEN 0.4::DOUBLE ELSE 0 END AS f FROM ref) r USING (file_id, ipu_id) WHERE event_id % 17 <> 0 AND event_id % 23 <> 0 AND NOT (label = 'view' AND event_id % 2 = 0) AND event_id % 29 <> 0""", "coverage dev_word_ms", [UNITS], digits=3, big="n_devs")
def a06(spark, sf):
    u = B.windowed_units(spark, sf)
    one = u.groupBy("file_id", "ipu_id").agg(F.count("*").alias("k"), F.max("event_id").alias("e")).where("k = 1 and e % 29 <> 0 and e % 23 <> 0").select("file_id", "ipu_id")
    keep = u.join(one, ["file_id", "ipu_id"])
    seq = lambda d: d.groupBy("file_id", "ipu_id").agg(F.array_sort(F.collect_list(F.struct("t_start", "t_end", "label"))))
    h = B.hyp_units(spark, sf, keep).join(keep.select("event_id", "ipu_id"), "event_id")
    d = seq(keep).toDF("file_id", "ipu_id", "ref").join(seq(h).toDF("file_id", "ipu_id", "hyp"), ["file_id", "ipu_id"])
    out = A.deviation_summary(A.pair_deviations(d.withColumn("site", F.lit(0)), ["file_id", "ipu_id"]), ["file_id", "ipu_id"])
    return out.select("file_id", "ipu_id", "n_devs", "coverage", "dev_word_ms")


_LISTS = "SELECT file_id, ipu_id, list(label ORDER BY t_start, t_end, label) AS {0}, list(t_start ORDER BY t_start, t_end, label) AS {0}0, list(t_end ORDER BY t_start, t_end, label) AS {0}1 FROM {1} GROUP BY 1, 2"


@query("a06_deviations_all_windows", f"""WITH RECURSIVE {UNITS}, {HYP}, hw AS (SELECT hyp.*, ref.ipu_id FROM hyp JOIN ref USING (event_id)),
  pairs AS (SELECT * FROM ({_LISTS.format("a", "ref")}) JOIN ({_LISTS.format("b", "(SELECT * FROM hw)")}) USING (file_id, ipu_id)),
  {edit_ctes("file_id, ipu_id", _unit_sql)},
  devs AS (SELECT file_id, ipu_id, pi, len(a) AS n, unnest([abs(a0[pi] - b0[pj]), abs(a1[pi] - b1[pj])]) * 1000 AS d FROM walk JOIN pairs USING (file_id, ipu_id) WHERE kind = 'paired' AND a[pi] = b[pj])
  SELECT file_id, ipu_id, count(*) AS n_devs, count(*) / 2 / max(n) AS coverage, median(d) AS dev_word_ms, median(d) FILTER (pi >= n - 1) AS dev_site_ms FROM devs GROUP BY 1, 2""", "coverage dev_word_ms dev_site_ms")
def a06b(spark, sf):
    u = B.windowed_units(spark, sf)
    h = B.hyp_units(spark, sf, u).join(u.select("event_id", "ipu_id"), "event_id")
    seq = lambda d: d.groupBy("file_id", "ipu_id").agg(F.array_sort(F.collect_list(F.struct("t_start", "t_end", "label"))))
    d = seq(u).toDF("file_id", "ipu_id", "ref").join(seq(h).toDF("file_id", "ipu_id", "hyp"), ["file_id", "ipu_id"])
    return A.deviation_summary(A.pair_deviations(d.withColumn("site", F.size("ref") - 1), ["file_id", "ipu_id"]), ["file_id", "ipu_id"])


SOUNDS = ["k", "i", "i̥", "ɯ", "ɯ̥", "s", "a", "t"]


def sounded(spark, sf):
    """Units with sounds, their words (one per window) and a lexicon of variants."""
    e = F.col("event_id")
    u = B.windowed_units(spark, sf).withColumn("sound", F.element_at(F.array(*[F.lit(x) for x in SOUNDS]), ((e * 3 + F.floor(e / 7)) % 8 + 1).cast("int")))
    u = u.withColumn("wkey", F.concat_ws("#", "file_id", "ipu_id"))
    u = scan(u, ["wkey"], ["t_start", "event_id"], {"_n": number()})
    u = scan(u, ["file_id"], ["t_start", "event_id"], {"seq": number()})
    u = u.withColumn("pos", (F.col("_n") - 1).cast("int"))
    w = u.groupBy("wkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sound"))), lambda x: x["sound"]).alias("pron"), F.min("event_id").alias("e"))
    word = F.translate(F.regexp_replace(F.array_join("pron", ""), "i̥|ɯ̥|i|ɯ", "u"), "st", "kk")
    w = w.withColumn("word", word)
    lex = w.where("e % 9 <> 0").groupBy("word", "pron").agg(F.min("e").alias("ord"))
    return u, w.select("wkey", "word", "pron"), lex


def _list_sql(values):
    return ", ".join(f"'{v}'" for v in sorted(values))


_SOUND = f"({[*SOUNDS]})[((event_id * 3 + event_id // 7) % 8 + 1)::INT]"
_VALUE = f"CASE WHEN {{0}} IN ({_list_sql(VOICED_VOWELS)}) THEN 'V' WHEN {{0}} IN ({_list_sql(DEVOICED_VOWELS)}) THEN 'D' END"
#: the views of ``sounded``
SOUNDED = f"""{UNITS},
  su AS (SELECT *, file_id || '#' || ipu_id AS wkey, {_SOUND} AS sound, row_number() OVER (PARTITION BY file_id, ipu_id ORDER BY t_start, event_id) - 1 AS pos, row_number() OVER (PARTITION BY file_id ORDER BY t_start, event_id) AS seq FROM ref),
  sw0 AS (SELECT wkey, list(sound ORDER BY pos) AS pron, min(event_id) AS e FROM su GROUP BY 1),
  sw AS (SELECT wkey, e, pron, translate(regexp_replace(array_to_string(pron, ''), 'i̥|ɯ̥|i|ɯ', 'u', 'g'), 'st', 'kk') AS word FROM sw0),
  lex AS (SELECT word, pron, min(e) AS ord FROM sw WHERE e % 9 <> 0 GROUP BY 1, 2)"""
#: values of every variant of a word at every position and in every gap of every other
AT_PLACES = f"""pairs AS (SELECT x.word, array_to_string(x.pron, ' ') AS p, array_to_string(y.pron, ' ') AS v, x.pron AS a, y.pron AS b FROM lex x JOIN lex y USING (word)),
  {edit_ctes("p, v", _sound_sql)},
  at_pos AS (SELECT word, p, pi - 1 AS pos, CASE WHEN kind = 'paired' THEN {_VALUE.format("b[pj]")} ELSE 'A' END AS val FROM walk JOIN pairs USING (p, v) WHERE kind IN ('paired', 'left out')),
  gaps AS (SELECT word, p, v, unnest(range(0, len(a) + 1)) AS gap FROM pairs),
  put AS (SELECT p, v, pi AS gap, {_VALUE.format("b[pj]")} AS val FROM walk JOIN pairs USING (p, v) WHERE kind = 'added'),
  at_gap AS (SELECT word, p, gap, CASE WHEN bool_or(val = 'V') THEN 'V' WHEN bool_or(val = 'D') THEN 'D' ELSE 'A' END AS val FROM gaps LEFT JOIN put USING (p, v, gap) GROUP BY word, p, v, gap),
  vals AS (SELECT word, p, pos, NULL::BIGINT AS gap, coalesce(string_agg(DISTINCT val, '' ORDER BY val), '') AS vals FROM at_pos GROUP BY 1, 2, 3
    UNION ALL SELECT word, p, NULL, gap, string_agg(DISTINCT val, '' ORDER BY val) FROM at_gap GROUP BY word, p, gap)"""


@query("a07_values_at", f"""WITH RECURSIVE {SOUNDED}, {AT_PLACES}
  SELECT word, p AS pron, pos, gap, vals FROM vals WHERE gap IS NOT NULL OR string_split(p, ' ')[pos + 1] IN ({_list_sql(A.HIGH_BASE)})""", big="pos gap")
def a07(spark, sf):
    _, w, lex = sounded(spark, sf)
    none = F.lit(None).cast("int")
    at = w.select("word", "pron", F.posexplode("pron").alias("pos", "_s")).where(F.col("_s").isin(*sorted(A.HIGH_BASE))).select("word", "pron", "pos", none.alias("gap"))
    between = w.select("word", "pron", none.alias("pos"), F.explode(F.sequence(F.lit(0), F.size("pron"))).alias("gap"))
    v = A.values_at(at.unionByName(between), lex)
    return v.select("word", F.array_join("pron", " ").alias("pron"), "pos", "gap", "vals")


@query("g21_competing_positions", f"""WITH RECURSIVE {SOUNDED},
  anchors AS (SELECT word, first(pron ORDER BY len(list_filter(pron, lambda x: x IN ({_list_sql(A.ALL_VOWELS)}))) DESC, len(pron) DESC, ord) AS a FROM lex GROUP BY 1 HAVING count(*) > 1),
  pairs AS (SELECT word, array_to_string(a, ' ') AS p, array_to_string(pron, ' ') AS v, a, pron AS b FROM lex JOIN anchors USING (word)),
  {edit_ctes("p, v", _sound_sql)},
  e AS (SELECT word, p, v, pi - 1 AS pos, CASE WHEN kind = 'paired' THEN {_VALUE.format("b[pj]")} ELSE 'A' END AS value FROM walk JOIN pairs USING (p, v) WHERE kind IN ('paired', 'left out') AND a[pi] IN ({_list_sql(A.HIGH_BASE)}))
  SELECT word, p AS anchor, v AS pron, pos, value FROM e SEMI JOIN (SELECT word, pos FROM e GROUP BY 1, 2 HAVING bool_or(value = 'V') AND bool_or(value IN ('D', 'A'))) USING (word, pos)""", big="pos")
def g21(spark, sf):
    _, _, lex = sounded(spark, sf)
    c = TK.competing_positions(lex)
    return c.select("word", F.array_join("anchor", " ").alias("anchor"), F.array_join("pron", " ").alias("pron"), "pos", "value")


@query("m06_decide_tokens", f"""WITH RECURSIVE {SOUNDED}, {ALN}, {AT_PLACES},
  un AS (SELECT 'h' || event_id AS unit_id, file_id, seq, wkey, pos, sound AS label FROM su),
  al AS (SELECT file_id, ref_unit_id, error_type, event_id % 3 < 2 AS wanted, event_id % 4 = 0 AS fused, row_number() OVER (PARTITION BY file_id ORDER BY t_start, event_id) AS place,
    CASE WHEN event_id % 5 = 0 AND len(hyp_unit_ids) > 0 THEN hyp_unit_ids || ['h' || lead(event_id) OVER (PARTITION BY file_id ORDER BY t_start, event_id)] ELSE hyp_unit_ids END AS ids FROM aln WHERE ref_unit_id IS NOT NULL),
  near AS (SELECT *, last_value(CASE WHEN len(ids) > 0 THEN ids[-1] END IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_id,
    first_value(CASE WHEN len(ids) > 0 THEN ids[1] END IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_id FROM al),
  hit AS (SELECT ref_unit_id, fused, q, wkey, pos, un.label IN ({_list_sql(A.ALL_VOWELS)}) AS vo, un.label IN ({_list_sql(A.HIGH_BASE)}) AS hi FROM (SELECT ref_unit_id, fused, unnest(ids) AS unit_id, unnest(range(0, len(ids))) AS q FROM near WHERE wanted AND error_type <> 'omission') JOIN un USING (unit_id)),
  mt AS (SELECT ref_unit_id, fused, count(*) FILTER (vo) AS nv, count(*) FILTER (hi) AS nh, first({{'w': wkey, 'p': pos}} ORDER BY q) FILTER (vo) AS v, first({{'w': wkey, 'p': pos}} ORDER BY q) FILTER (hi) AS h, first({{'w': wkey, 'p': pos}} ORDER BY q DESC) AS l FROM hit GROUP BY 1, 2),
  matched AS (SELECT ref_unit_id, CASE WHEN nv > 1 AND nh <> 1 THEN 'ambiguous_vowel_units' WHEN nv = 0 AND NOT fused THEN 'excluded_no_vowel' END AS reason,
    CASE WHEN nv = 0 AND fused THEN l.w WHEN nv = 1 THEN v.w WHEN nh = 1 THEN h.w END AS wkey, CASE WHEN nv = 1 THEN v.p WHEN nv > 1 AND nh = 1 THEN h.p END AS pos, CASE WHEN nv = 0 AND fused THEN l.p + 1 END AS gap, 0 AS rank FROM mt),
  sides AS (SELECT ref_unit_id, a.wkey AS aw, a.pos AS ap, b.wkey AS bw, b.pos AS bp, len(x.pron) AS al, prev_id IS NULL OR next_id IS NULL AS edge, coalesce(a.file_id = b.file_id AND b.seq = a.seq + 1, false) AS beside
    FROM near LEFT JOIN un a ON a.unit_id = prev_id LEFT JOIN un b ON b.unit_id = next_id LEFT JOIN sw x ON x.wkey = a.wkey WHERE wanted AND error_type = 'omission'),
  cands AS (SELECT *, CASE WHEN aw = bw THEN [{{'w': bw, 'g': bp, 'r': 0}}] ELSE list_filter([CASE WHEN ap = al - 1 THEN {{'w': aw, 'g': al, 'r': 0}} END, CASE WHEN bp = 0 THEN {{'w': bw, 'g': 0, 'r': 1}} END], lambda c: c IS NOT NULL) END AS c FROM sides),
  omitted AS (SELECT ref_unit_id, NULL::VARCHAR AS reason, c.w AS wkey, NULL::BIGINT AS pos, c.g AS gap, c.r AS rank FROM (SELECT ref_unit_id, unnest(c) AS c FROM cands WHERE NOT edge AND beside)
    UNION ALL SELECT ref_unit_id, CASE WHEN edge THEN 'omission_edge' WHEN NOT beside THEN 'omission_not_adjacent' ELSE 'omission_no_word' END, NULL, NULL, NULL, 0 FROM cands WHERE edge OR NOT beside OR len(c) = 0),
  chosen AS (SELECT * FROM (SELECT * FROM matched UNION ALL SELECT * FROM omitted) o LEFT JOIN (SELECT wkey, word, pron FROM sw) USING (wkey)
    LEFT JOIN (SELECT word AS w2, p, pos AS pos2, gap AS gap2, vals FROM vals) ON reason IS NULL AND w2 = word AND p = array_to_string(pron, ' ') AND pos2 IS NOT DISTINCT FROM pos AND gap2 IS NOT DISTINCT FROM gap
    QUALIFY row_number() OVER (PARTITION BY ref_unit_id ORDER BY NOT coalesce(contains(vals, 'V'), false), rank) = 1),
  told AS (SELECT *, CASE WHEN pos IS NOT NULL THEN {_VALUE.format("pron[pos + 1]")} ELSE 'A' END AS hv FROM chosen),
  why AS (SELECT * REPLACE (coalesce(reason, CASE WHEN wkey IS NULL OR (pos IS NULL AND gap IS NULL) THEN 'no_word' WHEN vals IS NULL THEN 'word_not_in_dictionary' WHEN hv IS NULL THEN 'position_not_vowel' END) AS reason) FROM told)
  SELECT ref_unit_id, reason, wkey, word, pos, gap, CASE WHEN reason IS NULL THEN vals END AS vals, CASE WHEN reason IS NULL THEN hv END AS hyp_value, CASE WHEN reason IS NULL THEN CASE WHEN hv IN ('D', 'A') THEN 'devoiced' ELSE 'voiced' END END AS hyp_label,
    CASE WHEN reason IS NULL THEN CASE WHEN vals LIKE '%V%' AND (vals LIKE '%D%' OR vals LIKE '%A%') THEN 'competing' ELSE 'lexical' END END AS status,
    CASE WHEN reason IS NULL THEN CASE WHEN vals LIKE '%V%' AND vals LIKE '%D%' AND vals LIKE '%A%' THEN 'mixed' WHEN vals LIKE '%V%' AND vals LIKE '%D%' THEN 'symbol' WHEN vals LIKE '%V%' AND vals LIKE '%A%' THEN 'presence' ELSE '' END END AS ctype FROM why""", big="pos gap")
def m06(spark, sf):
    u, w, lex = sounded(spark, sf)
    e = F.col("event_id")
    units = u.select(F.concat(F.lit("h"), e.cast("string")).alias("unit_id"), "file_id", "seq", "wkey", "pos", F.col("sound").alias("label"))
    a = scan(B.alignment(spark, sf).where("ref_unit_id is not null"), ["file_id"], ["t_start", "event_id"], {"place": number(), "after": lead("event_id")})
    # every fifth reference also meets the next unit, so that some meet two vowels
    more = F.when((e % 5 == 0) & (F.size("hyp_unit_ids") > 0), F.concat("hyp_unit_ids", F.array(F.concat(F.lit("h"), F.col("after").cast("string"))))).otherwise(F.col("hyp_unit_ids"))
    a = a.select("file_id", "place", "ref_unit_id", "error_type", more.alias("hyp_unit_ids"), (e % 3 < 2).alias("wanted"), (e % 4 == 0).alias("fused"))
    return TK.decide_tokens(a, units, w, lex)
