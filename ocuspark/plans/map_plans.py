"""Saliency-map, pixel and search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ocuspark.functions.columns import r6
from ocuspark.operators import layout, maps, pixels, search
from ocuspark.operators.lineage import stored
from ocuspark.plans.layout_plans import DESC
from ocuspark.plans.registry import query

M = ("map_pixels",)
P = ("rgb_pixels",)


def _rounded(df, keys, digits=6):
    return df.select(*keys, *[F.round(c, digits).alias(c) for c in df.columns if c not in keys])


# ---- Maps ----------------------------------------------------------------


@query(
    "map_normalise",
    """WITH s AS (SELECT *, min(pred) OVER m AS lo, max(pred) OVER m AS hi, sum(pred) OVER m AS tot, count(*) OVER m AS n
      FROM map_pixels WINDOW m AS (PARTITION BY map_id))
    SELECT map_id, y, x, round(CASE WHEN hi - lo < 1e-12 THEN 0 ELSE (pred - lo) / (hi - lo) END, 6) AS minmax,
      round(CASE WHEN tot < 1e-12 THEN 1e0 / n ELSE pred / tot END, 6) AS prob,
      round(CASE WHEN hi > 0 THEN pred / hi ELSE pred END, 6) AS maxed FROM s""",
    M,
)
def _(t):
    out = maps.normalise(t["map_pixels"])
    return out.select("map_id", "y", "x", *[r6(c).alias(c) for c in ("minmax", "prob", "maxed")])


@query(
    "map_scale_and_binarise",
    """WITH g AS (SELECT map_id, y, x, gt * CASE WHEN map_id % 2 = 0 THEN 1000 ELSE 1 END AS gt, pred * 8 AS fix FROM map_pixels)
    SELECT map_id, y, x, round(CASE WHEN max(gt) OVER (PARTITION BY map_id) > 1 THEN gt / 255 ELSE gt END, 6) AS gt,
      CASE WHEN fix > 0.5 THEN 1e0 ELSE 0e0 END AS fix FROM g""",
    M,
)
def _(t):
    g = t["map_pixels"].selectExpr(
        "map_id", "y", "x", "gt * case when map_id % 2 = 0 then 1000 else 1 end as gt", "pred * 8 as fix"
    )
    return maps.scale_and_binarise(g).select("map_id", "y", "x", r6("gt").alias("gt"), "fix")


@query(
    "map_saliency_features",
    """WITH s AS (SELECT map_id, y, x, pred AS v, sum(pred) OVER m AS tot, max(pred) OVER m AS hi, max(x) OVER m + 1 AS w,
        max(y) OVER m + 1 AS h FROM map_pixels WINDOW m AS (PARTITION BY map_id)),
    c AS (SELECT *, x / greatest(w - 1, 1) AS xx, y / greatest(h - 1, 1) AS yy,
        CASE WHEN hi > 0 THEN v / hi ELSE v END AS sv FROM s),
    mom AS (SELECT map_id, sum(xx * v) / sum(v) AS wx, sum(yy * v) / sum(v) AS wy FROM c GROUP BY 1),
    disp AS (SELECT c.map_id, sqrt(sum(pow(xx - wx, 2) * v) / sum(v) + sum(pow(yy - wy, 2) * v) / sum(v)) AS sigma,
        sum(CASE WHEN x >= floor(w * 0.25) AND x < floor(w * 0.75) AND y >= floor(h * 0.25) AND y < floor(h * 0.75) THEN v ELSE 0 END) / sum(v) AS cb,
        count(*) FILTER (sv > 0.5) / count(*) AS cov FROM c JOIN mom ON c.map_id = mom.map_id GROUP BY 1),
    hist AS (SELECT map_id, least(floor(sv * 32), 31) AS b, count(*) AS k FROM c GROUP BY 1, 2),
    ent AS (SELECT map_id, -sum(p * log2(p)) / 5 AS e FROM (SELECT map_id, k / sum(k) OVER (PARTITION BY map_id) AS p FROM hist) q GROUP BY 1)
    SELECT d.map_id, round(least(sigma / 0.707e0, 1), 6) AS saliency_dispersion, round(cb, 6) AS saliency_center_bias,
      round(e, 6) AS saliency_entropy, round(cov, 6) AS saliency_coverage FROM disp d JOIN ent ON d.map_id = ent.map_id""",
    M,
)
def _(t):
    return _rounded(maps.saliency_features(t["map_pixels"]), ["map_id"])


AGREE_SQL = """
WITH st AS (SELECT map_id, count(*) AS n, avg(pred) AS mp, stddev_pop(pred) AS dp, stddev_pop(gt) AS dg, sum(pred) AS sp, sum(gt) AS sg,
    avg(pred) FILTER (gt > 0) AS fm, corr(pred, gt) AS r FROM map_pixels GROUP BY 1),
sh AS (SELECT m.map_id, st.n, CASE WHEN sp < 1e-12 THEN 1e0 / st.n ELSE pred / sp END AS p,
    CASE WHEN sg < 1e-12 THEN 1e0 / st.n ELSE gt / sg END AS g FROM map_pixels m JOIN st ON m.map_id = st.map_id),
two AS (SELECT map_id, sum(least(p, g)) AS sim, sum((g + 1e-8) / (1 + n * 1e-8) * ln(((g + 1e-8) / (1 + n * 1e-8)) / ((p + 1e-8) / (1 + n * 1e-8)))) AS kl
  FROM sh GROUP BY 1),
agree AS (SELECT st.map_id, CASE WHEN dp < 1e-12 OR fm IS NULL THEN 0 ELSE (fm - mp) / dp END AS nss,
    CASE WHEN dp < 1e-12 OR dg < 1e-12 THEN 0 ELSE r END AS cc, sim, kl FROM st JOIN two ON st.map_id = two.map_id)
"""
AUC_SQL = """
fixs AS (SELECT map_id, pred AS v, row_number() OVER (PARTITION BY map_id ORDER BY pred DESC) AS i, count(*) OVER (PARTITION BY map_id) AS f
  FROM map_pixels WHERE gt > 0),
counts AS (SELECT map_id, pred AS v, count(*) AS k FROM map_pixels GROUP BY 1, 2),
above AS (SELECT map_id, v, sum(k) OVER (PARTITION BY map_id ORDER BY v DESC) AS a, sum(k) OVER (PARTITION BY map_id) AS p FROM counts),
pts AS (SELECT x.map_id, i, i / f AS tp, (a - (i - 1)) / (p - f) AS fp FROM fixs x JOIN above USING (map_id, v)
  UNION ALL SELECT DISTINCT map_id, 0, 0e0, 0e0 FROM fixs UNION ALL SELECT DISTINCT map_id, 1000000, 1e0, 1e0 FROM fixs),
traps AS (SELECT map_id, (fp - lag(fp) OVER w) * (tp + lag(tp) OVER w) / 2 AS area FROM pts WINDOW w AS (PARTITION BY map_id ORDER BY i)),
auc AS (SELECT map_id, sum(area) AS auc FROM traps GROUP BY 1)
"""


@query(
    "map_agreement",
    AGREE_SQL + "SELECT map_id, round(nss, 6) AS nss, round(cc, 6) AS cc, round(sim, 6) AS sim, round(kl, 6) AS kl FROM agree",
    M,
)
def _(t):
    return _rounded(maps.agreement(t["map_pixels"]), ["map_id"])


@query("map_auc_judd", "WITH " + AUC_SQL.strip() + " SELECT map_id, round(auc, 9) AS auc FROM auc", M)
def _(t):
    return _rounded(maps.auc_judd(t["map_pixels"]), ["map_id"], 9)


@query(
    "map_shuffled_auc",
    """WITH places AS (SELECT y, x, count(*) FILTER (gt > 0) AS k FROM map_pixels GROUP BY 1, 2),
    w AS (SELECT map_id, pred AS v, CASE WHEN gt > 0 THEN 1 ELSE 0 END AS pos, k - CASE WHEN gt > 0 THEN 1 ELSE 0 END AS neg
      FROM map_pixels m JOIN places p ON m.y = p.y AND m.x = p.x),
    d AS (SELECT map_id, v, sum(pos) AS pos, sum(neg) AS neg FROM w GROUP BY 1, 2),
    c AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY map_id ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM d)
    SELECT map_id, round(sum(pos * (nb + neg / 2)) / (sum(pos) * sum(neg)), 9) AS shuffled_auc FROM c GROUP BY 1""",
    M,
)
def _(t):
    return _rounded(maps.shuffled_auc(t["map_pixels"]), ["map_id"], 9)


@query(
    "map_validation_summary",
    AGREE_SQL + ", " + AUC_SQL.strip() + ", allm AS (SELECT a.*, auc FROM agree a LEFT JOIN auc USING (map_id)) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS metric, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std FROM allm"
        for c in ("nss", "cc", "sim", "kl", "auc")
    ),
    M,
)
def _(t):
    from ocuspark.operators.scoring import population_summary

    report = maps.validation_report(t["map_pixels"])
    return _rounded(population_summary(report, ["nss", "cc", "sim", "kl", "auc"]), ["metric", "n"])


TRAIN_SQL = """
WITH px AS (SELECT *, CASE WHEN gt > 0.05 THEN 1e0 ELSE 0e0 END AS fix FROM map_pixels),
st AS (SELECT map_id, count(*) AS n, avg(pred) AS mp, stddev_samp(pred) AS ds, corr(pred, gt) AS r, sum(pred) AS sp, sum(gt) AS sg,
    min(pred) AS plo, max(pred) AS phi, min(gt) AS glo, max(gt) AS ghi, sum(fix) AS sf FROM px GROUP BY 1),
a AS (SELECT px.map_id, pred / (sp + 1e-10) AS p, gt / (sg + 1e-10) AS g, (pred - plo) / (phi - plo + 1e-8) AS pn,
    (gt - glo) / (ghi - glo + 1e-8) AS gn, (pred - mp) / ds * fix / sf AS z FROM px JOIN st ON px.map_id = st.map_id),
b AS (SELECT *, sum(pn) OVER m + 1e-8 AS spn, sum(gn) OVER m + 1e-8 AS sgn FROM a WINDOW m AS (PARTITION BY map_id)),
t AS (SELECT map_id, sum(g * ln((g + 1e-10) / (p + 1e-10))) AS kl, sum(least(pn / spn, gn / sgn)) AS sim, sum(z) AS nss FROM b GROUP BY 1)
"""


@query(
    "map_composite_agreement",
    TRAIN_SQL + """SELECT t.map_id, round(kl, 6) AS kl, round(sim, 6) AS sim, round(coalesce(nss, 0), 6) AS nss, round(r, 6) AS cc,
      round(10 * kl - 3 * r + 0.5e0 * coalesce(nss, 0) + 0.25e0 * sim, 6) AS composite FROM t JOIN st ON t.map_id = st.map_id""",
    M,
)
def _(t):
    px = t["map_pixels"].withColumn("fix", F.when(F.col("gt") > 0.05, 1.0).otherwise(0.0))
    return _rounded(maps.composite_agreement(maps.training_agreement(px), 0.5, 0.25), ["map_id"])


@query(
    "map_edge_density",
    "SELECT map_id, round(avg(CASE WHEN pred > 0.1 THEN 1e0 ELSE 0e0 END), 6) AS edge_density FROM map_pixels GROUP BY 1",
    M,
)
def _(t):
    e = t["map_pixels"].withColumn("edge", F.col("pred") > 0.1)
    return _rounded(maps.edge_density(e), ["map_id"])


IDS = ("image_ids",)


@query(
    "map_highlight_ids",
    "SELECT image_id, contains(image_id, '_highlight') AS is_highlight FROM image_ids",
    IDS,
)
def _(t):
    from ocuspark.sources.tables import highlight_filter

    ids = t["image_ids"]
    plain = highlight_filter(ids, "none").withColumn("is_highlight", F.lit(False))
    return plain.unionByName(highlight_filter(ids, "highlight").withColumn("is_highlight", F.lit(True)))


@query(
    "map_highlight_pairs",
    r"""SELECT regexp_extract(a.image_id, '^(.*)_[^_]*$', 1) AS base, a.image_id AS first_id, b.image_id AS second_id
      FROM image_ids a JOIN image_ids b ON regexp_extract(a.image_id, '^(.*)_[^_]*$', 1) = regexp_extract(b.image_id, '^(.*)_[^_]*$', 1)
      WHERE a.image_id LIKE '%\_1' ESCAPE '\' AND b.image_id LIKE '%\_2' ESCAPE '\'""",
    IDS,
)
def _(t):
    from ocuspark.sources.tables import highlight_pairs

    return highlight_pairs(t["image_ids"])


@query(
    "map_image_truth_pairs",
    """WITH i AS (SELECT doc_id, lang, CASE lang WHEN 'en' THEN 'png' WHEN 'fr' THEN 'jpg' ELSE 'jpeg' END AS ext FROM documents
      UNION ALL SELECT doc_id, lang, 'webp' FROM documents)
    SELECT concat('shot_', CAST(i.doc_id AS VARCHAR(9))) AS stem, min(ext) AS image_ext FROM i
    WHERE lang <> 'de' GROUP BY 1""",
)
def _(t):
    from ocuspark.sources.tables import pair_by_stem

    # Every document has two images; those in one language lack the truth map.
    d = t["documents"].select("doc_id", "lang")
    name = F.concat(F.lit("shot_"), F.col("doc_id").cast("string"))
    ext = F.when(F.col("lang") == "en", ".png").when(F.col("lang") == "fr", ".jpg").otherwise(".jpeg")
    images = d.select(F.explode(F.array(*[F.concat(F.lit("/img/"), name, e) for e in (ext, F.lit(".webp"))])).alias("path"))
    truth = d.filter("lang <> 'de'").select(F.concat(F.lit("/gt/"), name, F.lit(".png")).alias("path"))
    pairs = pair_by_stem(images, truth)
    return pairs.select("stem", F.regexp_extract("image_path", r"\.([^.]*)$", 1).alias("image_ext"))


@query(
    "map_condition_manifest",
    """WITH c AS (SELECT unnest(['abs', 'low', 'high', 'all']) AS condition)
    SELECT concat('s', CAST(doc_id AS VARCHAR(9))) AS image_id, condition,
      concat('labels_', condition, '/s', CAST(doc_id AS VARCHAR(9)), '.png') AS label_path,
      concat('fixs_', condition, '/s', CAST(doc_id AS VARCHAR(9)), '.png') AS fixation_path
    FROM documents JOIN c ON NOT (condition = 'low' AND lang = 'es')""",
)
def _(t):
    from ocuspark.sources.tables import condition_manifest

    # Every document is an image; those in one language lack one condition's fixations.
    d = t["documents"].select(F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("image_id"), "lang")
    images = d.select("image_id")
    cond = F.explode(F.array(*[F.lit(c) for c in ("abs", "low", "high", "all")])).alias("condition")
    files = d.select("image_id", "lang", cond)

    def listing(prefix, rows):
        return rows.select(F.concat(F.lit(prefix), "condition", F.lit("/"), "image_id", F.lit(".png")).alias("path"))

    labels = listing("labels_", files)
    fixs = listing("fixs_", files.filter("not (condition = 'low' and lang = 'es')"))
    return condition_manifest(images, labels, fixs)


# ---- Pixels --------------------------------------------------------------

GREY_SQL = "((b * 3735 + g * 19235 + r * 9798 + 16384) >> 15)"


@query(
    "pixel_shannon_entropy",
    f"""WITH h AS (SELECT image_id, {GREY_SQL} AS v, count(*) AS k FROM rgb_pixels GROUP BY 1, 2),
    p AS (SELECT image_id, k / sum(k) OVER (PARTITION BY image_id) AS p FROM h)
    SELECT image_id, round(-sum(p * log2(p)), 6) AS shannon_entropy FROM p GROUP BY 1""",
    P,
)
def _(t):
    return _rounded(pixels.shannon_entropy(t["rgb_pixels"]), ["image_id"])


SYM_SQL = f"""
gm AS (SELECT image_id, y, x, {GREY_SQL} - avg({GREY_SQL}) OVER (PARTITION BY image_id) AS v, max(x) OVER (PARTITION BY image_id) AS mx,
    max(y) OVER (PARTITION BY image_id) AS my FROM rgb_pixels),
sym AS (SELECT a.image_id, least(greatest((sum(a.v * h.v) / sum(a.v * a.v) + sum(a.v * d.v) / sum(a.v * a.v)) / 2, 0), 1) AS layout_symmetry
  FROM gm a JOIN gm h ON a.image_id = h.image_id AND a.y = h.y AND h.x = a.mx - a.x
  JOIN gm d ON a.image_id = d.image_id AND a.x = d.x AND d.y = a.my - a.y GROUP BY 1)"""


@query(
    "pixel_layout_symmetry",
    f"WITH {SYM_SQL.strip()} SELECT image_id, round(layout_symmetry, 6) AS layout_symmetry FROM sym",
    P,
)
def _(t):
    return _rounded(pixels.layout_symmetry(t["rgb_pixels"]), ["image_id"])


CHROMA_SQL = """
rng AS (SELECT *, greatest(b, g, r) AS v, greatest(b, g, r) - least(b, g, r) AS d FROM rgb_pixels),
hsv AS (SELECT *, CASE WHEN v > 0 THEN (d * CAST(round_even(1044480e0 / v, 0) AS BIGINT) + 2048) >> 12 ELSE 0 END AS s,
    CASE WHEN d > 0 THEN CAST(floor(((CASE WHEN v = r THEN g - b WHEN v = g THEN b - r + 2 * d ELSE r - g + 4 * d END)
      * CAST(round_even(122880e0 / d, 0) AS BIGINT) + 2048) / 4096e0) AS BIGINT) ELSE 0 END AS h0 FROM rng),
hue AS (SELECT *, radians(2e0 * CASE WHEN h0 < 0 THEN h0 + 180 ELSE h0 END) AS a FROM hsv),
chs AS (SELECT image_id, stddev_pop(0.2126e0 * r + 0.7152e0 * g + 0.0722e0 * b) AS l, stddev_pop(r - g) AS drg,
    stddev_pop(0.5e0 * (r + g) - b) AS dyb, avg(r - g) AS mrg, avg(0.5e0 * (r + g) - b) AS myb,
    sqrt(pow(avg(sin(a)), 2) + pow(avg(cos(a)), 2)) AS rl, stddev_pop(s / 255e0) AS st FROM hue GROUP BY 1),
chroma AS (SELECT image_id, (least(l / 128, 1) + least((sqrt(drg * drg + dyb * dyb) + 0.3e0 * sqrt(mrg * mrg + myb * myb)) / 150, 1)
    + least(sqrt(-2 * ln(greatest(least(rl, 1e0), 1e-10))) / 2.5e0, 1) + least(st / 0.5e0, 1)) / 4 AS chromatic_coherence FROM chs)"""


@query(
    "pixel_chromatic_coherence",
    f"WITH {CHROMA_SQL.strip()} SELECT image_id, round(chromatic_coherence, 6) AS chromatic_coherence FROM chroma",
    P,
)
def _(t):
    return _rounded(pixels.chromatic_coherence(t["rgb_pixels"]), ["image_id"])


def _lin(c: str) -> str:
    return f"CASE WHEN {c} / 255e0 <= 0.03928e0 THEN {c} / 255e0 / 12.92e0 ELSE pow(({c} / 255e0 + 0.055e0) / 1.055e0, 2.4e0) END"


LUM_SQL = f"0.2126e0 * ({_lin('r')}) + 0.7152e0 * ({_lin('g')}) + 0.0722e0 * ({_lin('b')})"


@query(
    "pixel_relative_luminance",
    f"SELECT image_id, round(avg({LUM_SQL}), 6) AS mean_luminance, round(max({LUM_SQL}), 6) AS max_luminance FROM rgb_pixels GROUP BY 1",
    P,
)
def _(t):
    lum = pixels.relative_luminance()
    return t["rgb_pixels"].groupBy("image_id").agg(
        r6(F.avg(lum)).alias("mean_luminance"), r6(F.max(lum)).alias("max_luminance")
    )


OTSU_SQL = f"""
lum AS (SELECT image_id, {LUM_SQL} AS l FROM rgb_pixels),
lev AS (SELECT image_id, CAST(floor(least(greatest(l * 255, 0), 255)) AS INT) AS level, count(*) AS n, sum(l) AS s FROM lum GROUP BY 1, 2),
cum AS (SELECT *, sum(n) OVER w AS n1, sum(level * n) OVER w AS s1, sum(n) OVER (PARTITION BY image_id) AS nt,
    sum(level * n) OVER (PARTITION BY image_id) AS st FROM lev WINDOW w AS (PARTITION BY image_id ORDER BY level)),
sig AS (SELECT *, n1 * (nt - n1) * pow(s1 / n1 - (st - s1) / (nt - n1), 2) AS sigma FROM cum WHERE n1 < nt),
otsu AS (SELECT image_id, arg_max(level, struct_pack(s := sigma, l := -level)) AS threshold FROM sig GROUP BY 1)"""


@query(
    "pixel_otsu_threshold",
    f"WITH {OTSU_SQL.strip()} SELECT image_id, threshold FROM otsu",
    P,
)
def _(t):
    lum = F.floor(F.least(F.greatest(pixels.relative_luminance() * 255.0, F.lit(0.0)), F.lit(255.0)))
    hist = t["rgb_pixels"].groupBy("image_id", lum.cast("int").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    return pixels.otsu_threshold(hist, ["image_id"])


@query(
    "pixel_contrast_ratio",
    f"""WITH {OTSU_SQL.strip()} SELECT l.image_id, coalesce(round((sum(s) FILTER (level > threshold) / sum(n) FILTER (level > threshold) + 0.05e0)
      / (sum(s) FILTER (level <= threshold) / sum(n) FILTER (level <= threshold) + 0.05e0), 2), 1) AS contrast_ratio
    FROM lev l LEFT JOIN otsu o ON l.image_id = o.image_id GROUP BY 1""",
    P,
)
def _(t):
    return pixels.contrast_ratio(t["rgb_pixels"])


@query(
    "pixel_batch_summary",
    f"""WITH ent AS (SELECT image_id, -sum(p * log2(p)) AS shannon_entropy FROM (SELECT image_id, k / sum(k) OVER (PARTITION BY image_id) AS p
      FROM (SELECT image_id, {GREY_SQL} AS v, count(*) AS k FROM rgb_pixels GROUP BY 1, 2) h) p GROUP BY 1), {SYM_SQL.strip()}, {CHROMA_SQL.strip()},
    vec AS (SELECT * FROM ent JOIN sym USING (image_id) JOIN chroma USING (image_id)) """
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(min({c}), 6) AS min, round(max({c}), 6) AS max, round(avg({c}), 6) AS mean FROM vec"
        for c in ("shannon_entropy", "layout_symmetry", "chromatic_coherence")
    ),
    P,
)
def _(t):
    vec = pixels.visual_vector(t["rgb_pixels"])
    return _rounded(
        pixels.feature_range(vec, ["shannon_entropy", "layout_symmetry", "chromatic_coherence"]), ["feature"]
    )


COEFF = """SELECT map_id AS image_id, CASE y % 3 WHEN 0 THEN 'l' WHEN 1 THEN 'a' ELSE 'b' END AS channel, x % 2 AS band, pred AS value,
  max(pred) OVER (PARTITION BY map_id, y % 3) - min(pred) OVER (PARTITION BY map_id, y % 3) AS channel_range FROM {map_pixels} m"""
COEFF_SQL = "WITH co AS (" + COEFF.replace("{map_pixels}", "map_pixels") + """),
st AS (SELECT *, count(*) OVER w AS n, min(value) OVER w AS lo, max(value) OVER w AS hi FROM co WINDOW w AS (PARTITION BY image_id, channel, band)),
hist AS (SELECT image_id, channel, band, channel_range, CASE WHEN hi > lo THEN floor((value - lo) * (ceil(sqrt(n)) - 1) / (hi - lo)) ELSE 0 END AS bin,
    count(*) AS k FROM st GROUP BY ALL),
ent AS (SELECT image_id, channel, band, channel_range, -sum(p * ln(p)) AS e FROM (SELECT *, k / sum(k) OVER (PARTITION BY image_id, channel, band) AS p FROM hist) q
  GROUP BY ALL),
chan AS (SELECT image_id, channel, avg(CASE WHEN channel <> 'l' AND channel_range < 0.008e0 THEN 0 ELSE e END) AS e FROM ent GROUP BY 1, 2)
"""


@query(
    "pixel_subband_entropy",
    COEFF_SQL + "SELECT image_id, round(sum(CASE WHEN channel = 'l' THEN e ELSE 0.0625e0 * e END) / 1.125e0, 6) AS subband_entropy FROM chan GROUP BY 1",
    M,
)
def _(t):
    co = t.spark.sql(COEFF, map_pixels=t["map_pixels"])
    return _rounded(pixels.subband_entropy(co), ["image_id"])


@query(
    "pixel_interactive_density",
    """SELECT screen_id, round(count(*) FILTER (a > 480 AND a < 240000 AND greatest(w, h) / least(w, h) < 10 AND a / (w * h) > 0.3)
      / 96e0, 6) AS interactive_element_density FROM (SELECT *, w * h * (0.1e0 + (element_id % 9) / 10e0) AS a FROM elements) e GROUP BY 1""",
    ("elements",),
)
def _(t):
    regions = t["elements"].selectExpr(
        "screen_id", "w", "h", "w * h * (0.1e0 + (element_id % 9) / 10e0) as region_area", "960000 as img_area"
    )
    return _rounded(pixels.element_density(regions), ["screen_id"])


@query(
    "pixel_visual_hierarchy",
    """WITH lv AS (SELECT screen_id, k, count(*) FILTER (contrast_ratio > 1 + k / 2e0) AS n FROM elements, range(7) r(k) GROUP BY 1, 2),
    w AS (SELECT screen_id, k, n, lead(n) OVER (PARTITION BY screen_id ORDER BY k) AS nx FROM lv),
    fg AS (SELECT screen_id, CASE WHEN max(n) FILTER (k = 0) - max(n) FILTER (k = 6) > 0 THEN
        sum((n - nx) * k / 6e0) / (max(n) FILTER (k = 0) - max(n) FILTER (k = 6))
        WHEN max(n) FILTER (k = 6) > 0 THEN 1e0 ELSE 0e0 END AS c FROM w GROUP BY 1),
    top AS (SELECT screen_id, sum(area) / 960000e0 AS s FROM (SELECT screen_id, w * h AS area, row_number() OVER (PARTITION BY screen_id
        ORDER BY w * h DESC, element_id) AS i FROM elements) q WHERE i <= 3 GROUP BY 1)
    SELECT fg.screen_id, round((least(greatest(c, 0), 1) + least(greatest(s, 0), 1)) / 2, 9) AS visual_hierarchy
    FROM fg JOIN top ON fg.screen_id = top.screen_id""",
    ("elements",),
)
def _(t):
    e = t["elements"]
    # Seven counts a screen first, their rows after the shuffle.
    survive = [F.count_if(F.col("contrast_ratio") > 1 + k / 2.0).alias(f"_{k}") for k in range(7)]
    counts = e.groupBy("screen_id").agg(*survive)
    edges = counts.select("screen_id", F.posexplode(F.array(*[f"_{k}" for k in range(7)])).alias("level", "edges"))
    comps = e.selectExpr("screen_id", "element_id as component_id", "w * h as component_area", "960000 as img_area")
    return _rounded(pixels.visual_hierarchy(edges, comps), ["screen_id"], 9)


# ---- Element attention ----------------------------------------------------

DIST_SQL = DESC + """, pw AS (SELECT a.screen_id, a.element_id, sum((CASE WHEN a.color = b.color THEN 0 ELSE 1 END
      + abs(a.area - b.area) / (a.area + b.area)) / sqrt(greatest(sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2)), 1))) AS v, count(b.element_id) AS k
    FROM el a LEFT JOIN el b ON a.screen_id = b.screen_id AND a.element_id <> b.element_id GROUP BY 1, 2),
dist AS (SELECT screen_id, element_id, CASE WHEN k = 0 THEN 1 WHEN max(v) OVER (PARTITION BY screen_id) > 0
    THEN v / max(v) OVER (PARTITION BY screen_id) ELSE v END AS d FROM pw)
"""
SAL_SQL = """,
bx AS (SELECT screen_id, element_id, least(CAST(floor(x * (8 / 1200e0)) AS INT), 7) AS x0, least(CAST(floor(y * (8 / 800e0)) AS INT), 7) AS y0,
    greatest(1, CAST(floor(w * (8 / 1200e0)) AS INT)) AS sw, greatest(1, CAST(floor(h * (8 / 800e0)) AS INT)) AS sh FROM el),
sm AS (SELECT b.screen_id, b.element_id, avg(m.pred) AS v FROM bx b JOIN map_pixels m ON m.map_id = b.screen_id
    AND m.x >= x0 AND m.x < least(x0 + sw, 8) AND m.y >= y0 AND m.y < least(y0 + sh, 8) GROUP BY 1, 2),
sal AS (SELECT *, CASE WHEN max(v) OVER (PARTITION BY screen_id) > 0 THEN v / max(v) OVER (PARTITION BY screen_id) ELSE v END AS saliency FROM sm)
"""
EM = ("elements", "map_pixels")


def _described(t):
    return layout.describe_elements(t["elements"])


def _saliency(t):
    px = t["map_pixels"].withColumnRenamed("map_id", "screen_id")
    screens = t["screens"].withColumns({"map_w": F.lit(8), "map_h": F.lit(8)})
    # Stored: a few are broadcast to the elements.
    mapped = stored(px.select("screen_id").distinct(), "mapped-screens")
    return search.element_saliency(px, t.elements_of(mapped), screens, tile=4)


@query(
    "search_distinctiveness",
    DIST_SQL + "SELECT screen_id, element_id, round(d, 6) AS distinctiveness FROM dist",
    ("elements",),
)
def _(t):
    return _rounded(search.distinctiveness(_described(t)), ["screen_id", "element_id"])


@query(
    "search_element_saliency",
    DESC + SAL_SQL + "SELECT screen_id, element_id, round(saliency, 6) AS saliency FROM sal",
    EM,
)
def _(t):
    return _rounded(_saliency(t), ["screen_id", "element_id"])


SIMILAR_SQL = """, tgt AS (SELECT screen_id, max(element_id) AS target_id FROM elements GROUP BY 1),
simi AS (SELECT a.screen_id, t.target_id, a.element_id, 0.5e0 * CASE WHEN a.color = b.color THEN 1 ELSE 0 END
    + 0.5e0 * (1 - abs(a.area - b.area) / (a.area + b.area)) AS similarity
  FROM tgt t JOIN el a ON a.screen_id = t.screen_id JOIN el b ON b.screen_id = t.screen_id AND b.element_id = t.target_id)
"""


def _targets(t):
    return t["elements"].groupBy("screen_id").agg(F.max("element_id").alias("target_id"))


@query(
    "search_target_similarity",
    DESC + SIMILAR_SQL + "SELECT screen_id, target_id, element_id, round(similarity, 6) AS similarity FROM simi",
    ("elements",),
)
def _(t):
    out = search.target_similarity(_described(t), _targets(t))
    return _rounded(out, ["screen_id", "target_id", "element_id"])


@query(
    "search_attention_priority",
    DIST_SQL + SAL_SQL + SIMILAR_SQL + """SELECT d.screen_id, d.element_id,
      round(1.1e0 * d.d + 0.8e0 * pow(coalesce(s.saliency, 0), 2) + 0.45e0 * i.similarity, 6) AS priority
    FROM dist d LEFT JOIN sal s ON d.screen_id = s.screen_id AND d.element_id = s.element_id
    LEFT JOIN simi i ON d.screen_id = i.screen_id AND d.element_id = i.element_id""",
    EM,
)
def _(t):
    out = search.priority_to_last(layout.describe_elements(t.elements_by_screen()), _saliency(t))
    return out.select("screen_id", "element_id", r6("priority").alias("priority"))


@query(
    "search_contrast_and_acuity_gates",
    """SELECT screen_id, element_id, round(least(greatest((3 - contrast_ratio) / 2, 0), 1), 6) AS contrast_deficit,
      w / 40e0 < 0.142e0 * pow(x / 40e0, 2) + 0.96e0 * (x / 40e0) AS below_acuity FROM elements""",
    ("elements",),
)
def _(t):
    return t["elements"].select(
        "screen_id",
        "element_id",
        r6(search.contrast_deficit(F.col("contrast_ratio"))).alias("contrast_deficit"),
        search.below_acuity(F.col("w") / 40.0, F.col("x") / 40.0).alias("below_acuity"),
    )


# ---- Search trials and scanpaths -------------------------------------------

T = ("search_trials",)
TARGETS_SQL = """
WITH tg AS (SELECT screen_id, target_id, round(avg(total_time_s), 4) AS search_time_s, round(stddev_pop(total_time_s), 4) AS search_time_std_s,
  round(avg(n_fixations), 2) AS fixation_count FROM search_trials GROUP BY 1, 2)
"""
BAND = "CASE WHEN {m} < 1 THEN 'easy' WHEN {m} < 2.5 THEN 'moderate' WHEN {m} < 5 THEN 'difficult' ELSE 'very_hard' END"


@query(
    "search_target_summary",
    TARGETS_SQL + "SELECT screen_id, target_id, search_time_s, search_time_std_s, fixation_count FROM tg",
    T,
)
def _(t):
    return search.target_summary(t["search_trials"])


@query(
    "search_layout_summary",
    TARGETS_SQL + f"""SELECT screen_id, count(*) AS n_elements, round(avg(search_time_s), 4) AS mean_search_time_s,
      max(search_time_s) AS max_search_time_s, min(search_time_s) AS min_search_time_s,
      round(stddev_pop(search_time_s), 4) AS search_time_std_s, round(avg(fixation_count), 6) AS mean_fixation_count,
      {BAND.format(m='avg(search_time_s)')} AS predicted_difficulty FROM tg GROUP BY 1""",
    T,
)
def _(t):
    out = search.layout_summary(search.target_summary(t["search_trials"]))
    return out.withColumn("mean_fixation_count", r6("mean_fixation_count"))


CURVE_SQL = """
WITH tg AS (SELECT n_exposures, screen_id, target_id, round(avg(total_time_s), 4) AS t FROM search_trials GROUP BY 1, 2, 3),
ly AS (SELECT n_exposures, screen_id, round(avg(t), 4) AS m, round(stddev_pop(t), 4) AS sd FROM tg GROUP BY 1, 2),
cv AS (SELECT n_exposures, avg(m) AS m, avg(sd) AS sd, count(*) AS n_layouts FROM ly GROUP BY 1),
ends AS (SELECT arg_min(m, n_exposures) AS novice, arg_max(m, n_exposures) AS expert FROM cv)
"""


@query(
    "search_practice_curve",
    CURVE_SQL + f"""SELECT n_exposures, n_layouts, round(m, 8) AS mean_search_time_s, round(sd, 8) AS search_time_std_s, round(ln(n_exposures), 4) AS memory_activation,
      {BAND.format(m='m')} AS predicted_difficulty, round(novice, 8) AS novice_search_time_s, round(expert, 8) AS expert_search_time_s,
      round(least(greatest((novice - expert) / novice, 0), 1), 8) AS search_time_reduction FROM cv, ends""",
    T,
)
def _(t):
    out = search.practice_curve(t["search_trials"])
    # Means of 200 four-decimal times can end on half of the sixth decimal.
    return _rounded(out, ["n_exposures", "n_layouts", "memory_activation", "predicted_difficulty"], 8)


AT = """CASE WHEN {n} <= 1 THEN m1 WHEN {n} < 10 THEN m1 + (m10 - m1) * ln({n}) / ln(10e0)
  WHEN {n} < 100 THEN m10 + (m100 - m10) * (ln({n}) - ln(10e0)) / (ln(100e0) - ln(10e0)) ELSE m100 END"""
PRODUCTS = """SELECT o_custkey AS product_id, count(*) AS n_screens, avg(o_totalprice) % 1000 / 1e3 AS consistency_score FROM {orders} o GROUP BY 1"""


@query(
    "search_product_learning",
    CURVE_SQL + ", pr AS (" + PRODUCTS.replace("{orders}", "orders") + f"""),
    pt AS (SELECT max(m) FILTER (n_exposures = 1) AS m1, max(m) FILTER (n_exposures = 10) AS m10, max(m) FILTER (n_exposures = 100) AS m100 FROM cv),
    x AS (SELECT pr.*, pt.*, u AS total_uses, u * (consistency_score + (1 - consistency_score) / n_screens) AS eff,
      100 * (consistency_score + (1 - consistency_score) / n_screens) AS last_eff, 100e0 / n_screens AS alone FROM pr, pt, (SELECT unnest([1, 10, 100]) AS u) us),
    y AS (SELECT *, {AT.format(n='greatest(1, round_even(eff, 0))')} AS at_use, {AT.format(n='greatest(1, round_even(last_eff, 0))')} AS steady,
      {AT.format(n='greatest(1, round_even(alone, 0))')} AS none FROM x)
    SELECT product_id, total_uses, round(eff, 8) AS effective_exposures, round(at_use, 8) AS mean_search_time_s, round(steady, 8) AS steady_state_time_s,
      round(none, 8) AS no_transfer_time_s, round(m100, 8) AS full_transfer_time_s,
      round(CASE WHEN none > 0 THEN least(greatest((none - steady) / none, 0), 1) ELSE 0 END, 8) AS benefit FROM y""",
    T,
)
def _(t):
    products = t.spark.sql(PRODUCTS, orders=t["orders"])
    out = search.product_learning(products, search.practice_curve(t["search_trials"]))
    out = out.drop("n_screens", "consistency_score")
    return _rounded(out, ["product_id", "total_uses"], 8)


@query(
    "search_bottlenecks",
    TARGETS_SQL + """SELECT screen_id, target_id, rank, round(search_time_s, 3) AS search_time_s, CASE WHEN m > 0 THEN
      round((search_time_s - m) / m * 100, 1) ELSE 0 END AS deviation_pct FROM (SELECT *, avg(search_time_s) OVER (PARTITION BY screen_id) AS m,
      CAST(row_number() OVER (PARTITION BY screen_id ORDER BY search_time_s DESC, target_id) AS INT) AS rank FROM tg) q WHERE rank <= 5""",
    T,
)
def _(t):
    return search.bottlenecks(search.target_summary(t["search_trials"]))


@query(
    "search_target_deviation",
    TARGETS_SQL + """, d AS (SELECT *, (search_time_s - m) / m AS dv FROM (SELECT *, avg(search_time_s) OVER (PARTITION BY screen_id) AS m FROM tg) q)
    SELECT screen_id, target_id, search_time_s, search_time_std_s,
      CASE WHEN target_id % 5 > 0 THEN target_id % 2 = 0 END AS search_success, round(m, 4) AS layout_mean_search_time_s, round(dv * 100, 1) AS deviation_pct,
      CASE WHEN round(dv * 100, 1) <= -15 THEN 'easier than layout average' WHEN round(dv * 100, 1) >= 15 THEN 'harder than layout average'
        ELSE 'around layout average' END AS relative_difficulty, round(search_time_s / m, 3) AS time_ratio,
      round(least(greatest(25 * dv, -15), 15), 2) AS search_load_modifier FROM d""",
    T,
)
def _(t):
    targets = search.target_summary(t["search_trials"])
    outcomes = targets.filter("target_id % 5 > 0").selectExpr("screen_id", "target_id", "target_id % 2 = 0 AS search_success")
    return search.target_deviation(targets, outcomes)


@query(
    "search_median_trial",
    """SELECT screen_id, target_id, n_exposures, trial, n_fixations, round(total_time_s, 6) AS total_time_s FROM (
      SELECT *, row_number() OVER (PARTITION BY screen_id, target_id, n_exposures ORDER BY n_fixations, trial) AS i,
        count(*) OVER (PARTITION BY screen_id, target_id, n_exposures) AS n FROM search_trials) q WHERE i = n // 2 + 1""",
    T,
)
def _(t):
    out = search.median_trial(t["search_trials"])
    return out.select(
        "screen_id", "target_id", "n_exposures", "trial", "n_fixations", r6("total_time_s").alias("total_time_s")
    )


@query(
    "search_cumulative_scanpath",
    """SELECT scan_id, step_ord, round(step_time_s, 6) AS step_time_s, round(sum(step_time_s) OVER (PARTITION BY scan_id ORDER BY step_ord), 6)
      AS t_cumulative_s, is_target FROM scan_steps""",
    ("scan_steps",),
)
def _(t):
    out = search.cumulative_scanpath(t["scan_steps"])
    return out.select(
        "scan_id", "step_ord", r6("step_time_s").alias("step_time_s"), r6("t_cumulative_s").alias("t_cumulative_s"), "is_target"
    )


@query(
    "search_scan_outcome",
    """SELECT scan_id, count(*) AS n_steps, round(sum(step_time_s), 6) AS total_time_s, arg_max(is_target, step_ord) AS search_success
      FROM scan_steps GROUP BY 1""",
    ("scan_steps",),
)
def _(t):
    return search.scan_outcome(t["scan_steps"]).withColumn("total_time_s", r6("total_time_s"))


@query(
    "search_glance_metrics",
    """WITH RECURSIVE st AS (SELECT scan_id, step_time_s AS s, row_number() OVER (PARTITION BY scan_id ORDER BY step_ord) AS i
      FROM scan_steps WHERE step_time_s > 0),
    walk AS (SELECT scan_id, i, s AS cur, 0 AS n, 0e0 AS longest, s AS tot FROM st WHERE i = 1
      UNION ALL SELECT w.scan_id, st.i, CASE WHEN w.cur + st.s > 1.5 THEN st.s ELSE w.cur + st.s END,
        CASE WHEN w.cur + st.s > 1.5 THEN w.n + 1 ELSE w.n END, CASE WHEN w.cur + st.s > 1.5 THEN greatest(w.longest, w.cur) ELSE w.longest END, w.tot + st.s
      FROM walk w JOIN st ON st.scan_id = w.scan_id AND st.i = w.i + 1),
    fin AS (SELECT scan_id, arg_max(n, i) + 1 AS n, greatest(arg_max(longest, i), arg_max(cur, i)) AS longest, arg_max(tot, i) AS tot FROM walk GROUP BY 1)
    SELECT scan_id, CAST(n AS BIGINT) AS n_glances, round(longest, 6) AS max_single_glance_s, round(tot, 6) AS total_eyes_off_road_s,
      round(tot / n, 6) AS mean_glance_s, longest > 2 AS exceeds_single_glance, tot > 12 AS exceeds_cumulative, longest <= 2 AND tot <= 12 AS compliant FROM fin""",
    ("scan_steps",),
)
def _(t):
    return search.glance_metrics(t["scan_steps"], digits=6)


@query(
    "search_glance_list",
    """WITH RECURSIVE st AS (SELECT scan_id, step_ord, step_time_s AS s, row_number() OVER (PARTITION BY scan_id ORDER BY step_ord) AS i
      FROM scan_steps WHERE step_time_s > 0),
    walk AS (SELECT scan_id, i, step_ord, s AS cur, 1 AS g FROM st WHERE i = 1
      UNION ALL SELECT w.scan_id, st.i, st.step_ord, CASE WHEN w.cur + st.s > 1.5 THEN st.s ELSE w.cur + st.s END, CASE WHEN w.cur + st.s > 1.5 THEN w.g + 1 ELSE w.g END
      FROM walk w JOIN st ON st.scan_id = w.scan_id AND st.i = w.i + 1)
    SELECT scan_id, CAST(g AS BIGINT) AS glance, min(step_ord) AS start_ord, count(*) AS n_steps, round(max(cur), 6) AS time_s FROM walk GROUP BY scan_id, g""",
    ("scan_steps",),
)
def _(t):
    return search.glance_list(t["scan_steps"], digits=6)
