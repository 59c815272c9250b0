"""Queries of the waveform operators on the test tables: embeddings stand for waveforms of 64 samples."""

import numpy as np
from pyspark.sql import functions as F

from millrace.functions import arrays as A
from millrace.operators import pages, signals
from millrace.plans.catalogue import Catalogue
from millrace.plans.tables import table

C = Catalogue()

V = "v AS (SELECT vec_id, label, [x::DOUBLE for x in embedding] AS e FROM embeddings)"
# Each vector with the next one of its label.
P = V + ", n AS (SELECT *, lead(e) OVER (PARTITION BY label ORDER BY vec_id) AS g FROM v), p AS (SELECT * FROM n WHERE g IS NOT NULL)"
SUM = "list_sum([{x} for z in list_zip({a}, {b})])"


def _rounded(a, digits=6):
    return F.array_join(F.transform(a, lambda x: F.format_string("%.5f", F.round(x, 5) + 0.0)), ",")


def _text(sql: str) -> str:
    return f"array_to_string([printf('%.5f', round(x, 5) + 0.0) for x in {sql}], ',')"


def _waves(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("samples"))


def _pairs(spark, d):
    v = _waves(spark, d)
    nxt = F.lead("samples").over(signals.Window.partitionBy("label").orderBy("vec_id"))
    return v.select("vec_id", F.col("samples").alias("pred"), nxt.alias("gt")).where("gt is not null")


@C.add(f"WITH {V} SELECT vec_id, md5({_text('[e[floor(i * 0.64::DOUBLE)::INT + 1] + (coalesce(e[floor(i * 0.64::DOUBLE)::INT + 2], e[64]) - e[floor(i * 0.64::DOUBLE)::INT + 1]) * (i * 0.64::DOUBLE - floor(i * 0.64::DOUBLE)) for i in range(100)]')}) AS samples FROM v")
def sig_resample(spark, d):
    return _waves(spark, d).select("vec_id", F.md5(_rounded(A.resampled(F.col("samples"), 100))).alias("samples"))


@C.add(f"WITH {V} SELECT vec_id, md5({_text('[e[least(floor(i * 0.64::DOUBLE)::INT, 62) + 1] + (e[least(floor(i * 0.64::DOUBLE)::INT, 62) + 2] - e[least(floor(i * 0.64::DOUBLE)::INT, 62) + 1]) * (i * 0.64::DOUBLE - least(floor(i * 0.64::DOUBLE)::INT, 62)) for i in range(100)]')}) AS samples FROM v")
def sig_extrapolate(spark, d):
    return _waves(spark, d).select("vec_id", F.md5(_rounded(A.extrapolated(F.col("samples"), 100))).alias("samples"))


MET = P + """, m AS (SELECT vec_id, list_sum([abs(z[1] - z[2]) for z in list_zip(e, g)]) / 64 AS mae, sqrt(list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(e, g)]) / 64) AS rmse, list_sum(e) / 64 AS me, list_sum(g) / 64 AS mg, e, g FROM p),
 c AS (SELECT *, list_sum([(z[1] - me) * (z[2] - mg) for z in list_zip(e, g)]) / 64 AS cov, sqrt(list_sum([(x - me) * (x - me) for x in e]) / 64) AS se, sqrt(list_sum([(x - mg) * (x - mg) for x in g]) / 64) AS sg FROM m)"""


@C.add(f"WITH {MET} SELECT vec_id, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(cov / (se * sg), 6) AS corr FROM c")
def sig_metrics(spark, d):
    m = signals.metrics(_pairs(spark, d), ["vec_id"])
    return m.select("vec_id", *[F.round(c, 6).alias(c) for c in ("mae", "rmse", "corr")])


@C.add(f"WITH {MET} SELECT round(avg(mae), 6) AS mae, round(avg(rmse), 6) AS rmse, round(avg(cov / (se * sg)), 6) AS corr, count(*) AS n FROM c")
def sig_summary(spark, d):
    s = signals.summary(signals.metrics(_pairs(spark, d), ["vec_id"]))
    return s.select(*[F.round(c, 6).alias(c) for c in ("mae", "rmse", "corr")], "n")


# Each vector with itself backwards, or, every third one, with a flat line.
@C.add(f"""WITH {V}, p AS (SELECT vec_id, e, CASE WHEN vec_id % 3 = 0 THEN [1.5::DOUBLE for x in e] ELSE list_reverse(e) END AS g FROM v), m AS (SELECT *, list_sum(e) / 64 AS me, list_sum(g) / 64 AS mg FROM p),
 c AS (SELECT *, list_sum([(z[1] - me) * (z[2] - mg) for z in list_zip(e, g)]) / 64 AS cov, sqrt(list_sum([(x - me) * (x - me) for x in e]) / 64) AS se, sqrt(list_sum([(x - mg) * (x - mg) for x in g]) / 64) AS sg FROM m)
 SELECT vec_id, CASE WHEN se < 1e-8 OR sg < 1e-8 THEN 0 ELSE round(cov / (se * sg), 6) END::DOUBLE AS corr FROM c""")
def sig_safe_corr(spark, d):
    flat = F.transform(F.col("samples"), lambda x: F.lit(1.5))
    other = F.when(F.col("vec_id") % 3 == 0, flat).otherwise(F.reverse(F.transform("samples", lambda x: x.cast("double"))))
    return _waves(spark, d).select("vec_id", F.round(A.safe_correlation(F.col("samples"), other), 6).alias("corr"))


# Twelve vectors are a record's leads; the truth is each one twice in a row, from a segment's start on, where it has a segment.
def _leads(spark, d):
    record = F.concat(F.lit("r"), F.expr("vec_id div 12").cast("string")).alias("record")
    return _waves(spark, d).select("vec_id", record, F.get(F.array(*[F.lit(n) for n in signals.LEADS]), (F.col("vec_id") % 12).cast("int")).alias("lead"), "samples")


LEADS_SQL = "['I', 'II', 'III', 'AVR', 'AVL', 'AVF', 'V1', 'V2', 'V3', 'V4', 'V5', 'V6'][vec_id % 12 + 1]"


@C.add(f"""WITH {V}, s AS (SELECT vec_id, e, list_concat(e, e) AS t, CASE WHEN vec_id % 3 = 0 THEN 0 ELSE vec_id % 7 END AS a, CASE WHEN vec_id % 3 = 0 THEN 128 ELSE 100 END AS n FROM v), k AS (SELECT vec_id, e, t[a + 1:a + n] AS c, n FROM s),
 p AS (SELECT vec_id, e, [c[floor(i * n / 64.0::DOUBLE)::INT + 1] + (c[least(floor(i * n / 64.0::DOUBLE)::INT + 2, n)] - c[floor(i * n / 64.0::DOUBLE)::INT + 1]) * (i * n / 64.0::DOUBLE - floor(i * n / 64.0::DOUBLE)) for i in range(64)] AS g FROM k)
 SELECT 'r' || vec_id // 12 AS record, {LEADS_SQL} AS lead, round(list_sum([abs(z[1] - z[2]) for z in list_zip(e, g)]) / 64, 6) AS mae, round(sqrt(list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(e, g)]) / 64), 6) AS rmse FROM p""")
def sig_pairs(spark, d):
    w = _leads(spark, d)
    truth = w.select("record", "lead", F.concat("samples", "samples").alias("samples"))
    start = (F.col("vec_id") % 7).cast("int")
    cuts = w.where("vec_id % 3 <> 0").select("record", "lead", F.lit(0).alias("place"), start.alias("start_sample"), (start + 100).alias("end_sample"))
    m = signals.metrics(signals.pairs(w, truth, cuts), ["record", "lead"])
    return m.select("record", "lead", F.round("mae", 6).alias("mae"), F.round("rmse", 6).alias("rmse"))


@C.add("""WITH r AS (SELECT DISTINCT 'r' || vec_id // 12 AS record FROM embeddings), h AS (SELECT record, row_number() OVER (ORDER BY md5('42:' || record)) AS k, count(*) OVER () AS n FROM r)
 SELECT record, CASE WHEN k <= greatest(1, round(n * 0.2::DOUBLE)) THEN 'validation' ELSE 'train' END AS part FROM h""")
def sig_train_validation(spark, d):
    train, held = signals.train_validation(_leads(spark, d), 0.2)
    return train.select("record", F.lit("train").alias("part")).unionByName(held.select("record", F.lit("validation").alias("part"))).distinct()


# Every vector as a page: its twelve leads drawn in rows and columns, as a bitmap.
@C.add()
def sig_digitised(spark, d):
    def draw(batches):
        for b in batches:
            yield b.assign(content=[page_of(np.stack(w)) for w in b["waves"]])[["record", "content"]]

    def page_of(waves):
        page = np.full((390, 1000), 255, np.uint8)
        for k, w in enumerate(waves):
            y0, x0 = 130 * (k // 4) + 65, 250 * (k % 4)
            at = np.interp(np.linspace(0, len(w) - 1, 236), np.arange(len(w)), w)
            rows = np.clip(np.rint(y0 - 40 * at).astype(int), 130 * (k // 4) + 8, 130 * (k // 4) + 121)
            for x, (a, e) in enumerate(zip(rows, [*rows[1:], rows[-1]], strict=True)):
                page[min(a, e) - 1 : max(a, e) + 2, x0 + 7 + x] = 0
        return b"P5 1000 390 255\n" + page.tobytes()

    w = _leads(spark, d).groupBy("record").agg(F.sort_array(F.collect_list(F.struct("vec_id", "samples"))).alias("w")).where("size(w) = 12")
    drawn = w.select("record", F.transform("w", lambda x: x["samples"]).alias("waves")).mapInPandas(draw, "record string, content binary")
    return pages.digitised(drawn, samples=64)


@C.add(f"WITH {V}, s AS (SELECT label, avg(x) AS m, stddev_pop(x) AS s FROM (SELECT label, unnest(e) AS x FROM v) GROUP BY 1) SELECT vec_id, md5({_text('[(x - m) / s for x in e]')}) AS samples FROM v JOIN s USING (label)")
def sig_normalize(spark, d):
    w = _waves(spark, d)
    j = w.join(signals.scale_of(w, ["label"]), "label")
    return j.select("vec_id", F.md5(_rounded(A.affine(F.col("samples"), F.col("mean"), F.col("std")))).alias("samples"))


@C.add(f"""WITH {MET} SELECT vec_id, round(rmse * rmse + 0.5::DOUBLE * mae + 0.3::DOUBLE * list_sum([((e[i + 1] - e[i]) - (g[i + 1] - g[i])) * ((e[i + 1] - e[i]) - (g[i + 1] - g[i])) for i in range(1, 64)]) / 63
 + 0.2::DOUBLE * (1 - cov / (sqrt((se * se + 1e-8::DOUBLE) * (sg * sg + 1e-8::DOUBLE)) + 1e-8::DOUBLE)), 6) AS loss FROM c""")
def sig_loss(spark, d):
    return _pairs(spark, d).select("vec_id", F.round(A.composite_loss(F.col("pred"), F.col("gt"), 0.5, 0.3, 0.2), 6).alias("loss"))


@C.add(f"WITH {V} SELECT vec_id, md5({_text('[e[i + 1] - e[i] for i in range(1, 64)]')}) AS steps FROM v")
def sig_diff(spark, d):
    return _waves(spark, d).select("vec_id", F.md5(_rounded(A.differences(F.col("samples")))).alias("steps"))


@C.add(f"WITH {V} SELECT vec_id, md5({_text('[list_sum(e[greatest(i - 3, 1):least(i + 3, 64)]) / 7 for i in range(1, 65)]')}) AS smooth FROM v")
def sig_moving_avg(spark, d):
    return _waves(spark, d).select("vec_id", F.md5(_rounded(A.moving_mean(F.col("samples"), 7))).alias("smooth"))


# A profile: how many readings each device sends in each hour of the day.
HOURS = "h AS (SELECT event_type, CAST(hour(ts) + 24 * day(ts) AS INTEGER) AS place, count(*) AS n FROM events GROUP BY 1, 2)"


def _hours(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("event_type", (F.hour("ts") + 24 * F.dayofmonth("ts")).alias("place")).agg(F.count("*").alias("n"))


@C.add(f"""WITH {HOURS}, o AS (SELECT *, n >= greatest(1, 0.6::DOUBLE * max(n) OVER (PARTITION BY event_type)) AS f FROM h), r AS (SELECT *, sum(c) OVER (PARTITION BY event_type ORDER BY place) AS run FROM (SELECT *, (f <> lag(f, 1, FALSE) OVER (PARTITION BY event_type ORDER BY place))::INT AS c FROM o))
 SELECT event_type, min(place) AS start, max(place) AS "end" FROM r WHERE f GROUP BY event_type, run HAVING max(place) - min(place) + 1 >= 2""")
def sig_bands(spark, d):
    return signals.active_bands(_hours(spark, d), ["event_type"], "place", "n", 0.6, 2)


@C.add(f"""WITH {HOURS}, m AS (SELECT *, n >= lag(n) OVER w AND n >= lead(n) OVER w AND n >= greatest(1, 0.45::DOUBLE * max(n) OVER (PARTITION BY event_type)) AS k FROM h WINDOW w AS (PARTITION BY event_type ORDER BY place)),
 g AS (SELECT event_type, place - lag(place) OVER (PARTITION BY event_type ORDER BY place) AS gap FROM m WHERE k), s AS (SELECT event_type, median(gap) AS spacing FROM g WHERE gap BETWEEN 2 AND 80 GROUP BY 1)
 SELECT event_type, coalesce(spacing, 0)::DOUBLE AS spacing FROM (SELECT DISTINCT event_type FROM h) LEFT JOIN s USING (event_type)""")
def sig_peaks(spark, d):
    return signals.peak_spacing(_hours(spark, d), ["event_type"], "place", "n", low=2)


@C.add("""WITH w AS (SELECT 'r' || vec_id // 12 AS record, ['I', 'II', 'III', 'AVR', 'AVL', 'AVF', 'V1', 'V2', 'V3', 'V4', 'V5', 'X'][vec_id % 12 + 1] AS lead, embedding AS e FROM embeddings),
 m AS (SELECT record, unnest(['I', 'II', 'III', 'AVR', 'AVL', 'AVF', 'V1', 'V2', 'V3', 'V4', 'V5', 'V6']) AS lead FROM (SELECT DISTINCT record FROM w))
 SELECT record, lead, 'missing' AS issue FROM m ANTI JOIN w USING (record, lead) UNION ALL SELECT record, lead, 'unknown lead' FROM w WHERE lead = 'X' UNION ALL SELECT record, lead, 'peak' FROM w WHERE list_max([abs(x::DOUBLE) for x in e]) > 0.3""")
def sig_validate(spark, d):
    names = [*signals.LEADS[:11], "X"]
    w = _waves(spark, d).select(F.concat(F.lit("r"), F.expr("vec_id div 12").cast("string")).alias("record"), F.get(F.array(*[F.lit(n) for n in names]), (F.col("vec_id") % 12).cast("int")).alias("lead"), F.transform("samples", lambda x: x.cast("double")).alias("samples"))
    return signals.issues(w, length=64, peak=0.3)


KEYS = "k AS (SELECT vec_id, CASE vec_id % 4 WHEN 0 THEN 'rec_' || vec_id || '_AVR' WHEN 1 THEN 'rec_' || vec_id || '_V1' WHEN 2 THEN 'rec_' || vec_id || '_III' ELSE 'rec_' || vec_id END AS key FROM embeddings)"


@C.add(f"WITH {KEYS} SELECT vec_id, CASE WHEN vec_id % 4 < 3 THEN 'rec_' || vec_id END AS record, CASE vec_id % 4 WHEN 0 THEN 'AVR' WHEN 1 THEN 'V1' WHEN 2 THEN 'III' END AS lead FROM k")
def sig_key_split(spark, d):
    suffix = F.get(F.array(F.lit("_AVR"), F.lit("_V1"), F.lit("_III"), F.lit("")), (F.col("vec_id") % 4).cast("int"))
    k = _waves(spark, d).select("vec_id", F.concat(F.lit("rec_"), F.col("vec_id").cast("string"), suffix).alias("key"))
    return k.select("vec_id", signals.record_of(F.col("key")).alias("record"), signals.lead_of(F.col("key")).alias("lead"))


@C.add("SELECT vec_id, CASE vec_id % 4 WHEN 0 THEN 'AVR' WHEN 1 THEN 'AVL' WHEN 2 THEN 'AVF' ELSE 'V1' END AS lead FROM embeddings")
def sig_lead_alias(spark, d):
    raw = F.get(F.array(F.lit("aVR"), F.lit("aVL"), F.lit("aVF"), F.lit("V1")), (F.col("vec_id") % 4).cast("int"))
    return _waves(spark, d).select("vec_id", signals.lead_name(raw).alias("lead"))


@C.add("""WITH w AS (SELECT 'r' || vec_id // 7 AS record, ['I', 'II', 'III', 'V1', 'V2', 'V3', 'V4'][vec_id % 7 + 1] AS lead, list_sum([x::DOUBLE for x in embedding]) AS s FROM embeddings),
 m AS (SELECT record, unnest(['I', 'II', 'III', 'AVR', 'AVL', 'AVF', 'V1', 'V2', 'V3', 'V4', 'V5', 'V6']) AS lead FROM (SELECT DISTINCT record FROM w))
 SELECT record, lead, round(coalesce(s, 0), 5) AS total FROM m LEFT JOIN w USING (record, lead)""")
def sig_zero_fill(spark, d):
    names = F.array(*[F.lit(n) for n in ("I", "II", "III", "V1", "V2", "V3", "V4")])
    w = _waves(spark, d).select(F.concat(F.lit("r"), F.expr("vec_id div 7").cast("string")).alias("record"), F.get(names, (F.col("vec_id") % 7).cast("int")).alias("lead"), "samples")
    return signals.zero_filled(w, w, length=64).select("record", "lead", F.round(A.total(F.col("samples")), 5).alias("total"))


@C.add()
def sig_viterbi(spark, d):
    """Each vector drawn as a line of 64 columns and traced back."""
    row = F.transform("samples", lambda x: F.least(F.greatest(F.round(x * 40 + 20).cast("int"), F.lit(0)), F.lit(39)))
    pixel = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(39)), lambda y: F.transform(row, lambda r: F.when(r == y, F.lit("FF")).otherwise(F.lit("00")))))
    drawn = _waves(spark, d).select("vec_id", F.lit(40).alias("height"), F.lit(64).alias("width"), F.unhex(F.array_join(pixel, "")).alias("mask"), F.lit(4.0).alias("ppm"))
    return signals.traced(drawn, ["vec_id"], 64)
