"""Further queries: compositions of the operators, each with the SQL it is checked against.

Registered beside those of ``catalogue``, whose inputs, pinned models and SQL pieces are used here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import distances
from tessera.operators import binary, evaluation, ivf, knn, models, quantizers, transforms
from tessera.plans import factory
from tessera.plans.catalogue import (
    BIN, CB, CODES, L, M, NLIST, NPROBE, S_ADC, S_CAND, S_HAM, S_METRICS, A, V, _scratch, book, codes32, few, pinned, points, query, rounded, s_fold, s_ip, s_l2, s_pinned, s_top, vectors,
)
from tessera.sources import vectors as vector_files

#: Lists (L) and codes (CB) in one WITH.
LC = f"{L}, {CB[len(V) + 2:]}"
ALL_PAIRS = f"SELECT q.id AS qid, x.id, {S_METRICS['l2']} AS dis FROM v q, v x WHERE q.id % 50 = 0"


def coded_lists(v: DataFrame) -> DataFrame:
    """(list_no, id, vec, code, o2c)."""
    return quantizers.encode_pq(ivf.build(v, pinned(v)), book(v), "list_no", "o2c")


def probed(v: DataFrame) -> DataFrame:
    return ivf.probes(few(v), pinned(v), NPROBE)


def coded_candidates(v: DataFrame) -> DataFrame:
    """(qid, probe, list_no, q2c, id, o2c, dis): table distances of all entries of the probed lists."""
    c = probed(v).drop("qvec").join(coded_lists(v).select("list_no", "id", "code", "o2c"), "list_no").join(quantizers.tables(few(v), book(v)), "qid")
    return c.select("qid", "probe", "list_no", "q2c", "id", "o2c", quantizers.adc(F.col("lut"), F.col("code")).alias("dis"))


S_CODED = f"{LC}, k AS (SELECT id, list(code ORDER BY m) AS code FROM e GROUP BY id), d AS (SELECT p.qid, p.probe, p.list_no, p.q2c, l.id, l.o2c, sum(t.dis) AS dis FROM pr p JOIN l ON p.list_no = l.list_no JOIN e ON e.id = l.id JOIN t ON t.id = p.qid AND t.m = e.m AND t.code = e.code GROUP BY ALL)"


# Incremental index.


@query("a04_initial_index", f"WITH {LC}, k AS (SELECT id, list(code ORDER BY m) AS code FROM e GROUP BY id) SELECT l.list_no, l.id, k.code, round(l.o2c, 6) AS o2c FROM l JOIN k ON l.id = k.id")
def _(spark, sf):
    return rounded(coded_lists(vectors(spark, sf)).select("list_no", "id", "code", "o2c"), "o2c")


@query("a05_radius_and_size", f"WITH {L} SELECT list_no, round(max(sqrt(o2c)), 6) AS radius, count(*) AS size FROM l GROUP BY list_no")
def _(spark, sf):
    v = vectors(spark, sf)
    return rounded(ivf.list_statistics(ivf.build(v, pinned(v))), "radius")


@query("a06_add_with_o2c", f"WITH {L} SELECT list_no, count(*) AS size, round(sum(o2c), 5) AS total FROM l GROUP BY list_no")
def _(spark, sf):
    """A batch of odd ids joins lists of even ones."""
    v = vectors(spark, sf)
    c = pinned(v)
    both = ivf.build(v.where("id % 2 = 0"), c).unionByName(ivf.build(v.where("id % 2 = 1"), c))
    return both.groupBy("list_no").agg(F.count("*").alias("size"), F.round(F.sum("o2c"), 5).alias("total"))


@query("a07_add_with_given_codes", f"WITH {LC}, k AS (SELECT id, list(code ORDER BY m) AS code FROM e GROUP BY id) SELECT l.list_no, l.id, k.code FROM l JOIN k ON l.id = k.id")
def _(spark, sf):
    v = vectors(spark, sf)
    codes = quantizers.encode_pq(v, book(v)).select("id", "code")
    return ivf.build(v, pinned(v)).select("list_no", "id").join(codes, "id").select("list_no", "id", "code")


@query("a08_batch_to_old_clusters", f"""WITH {A}, {s_pinned(6, 2).replace('c AS', 'n AS')}, s AS (SELECT list_no, max(sqrt(dis)) AS r FROM a WHERE rank = 1 GROUP BY list_no),
nc AS (SELECT n.list_no AS new_no, c.list_no, {s_l2('n.vec', 'c.vec')} AS dis FROM n, c QUALIFY row_number() OVER (PARTITION BY n.list_no ORDER BY dis, c.list_no) = 1)
SELECT new_no, nc.list_no, round(dis, 6) AS dis, sqrt(dis) < r AS merges FROM nc JOIN s ON s.list_no = nc.list_no""")
def _(spark, sf):
    v = vectors(spark, sf)
    c = pinned(v)
    new = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(models.pinned_centroids(v, 6, 2))], "id int, vec array<double>")
    st = ivf.list_statistics(ivf.build(v, c)).select("list_no", "radius")
    near = models.assign(new, c).join(st, "list_no")
    return near.select(F.col("id").alias("new_no"), "list_no", F.round("dis", 6).alias("dis"), (F.sqrt("dis") < F.col("radius")).alias("merges"))


@query("a15_delete_prefix", f"WITH {L} SELECT list_no, count(*) FILTER (WHERE id < 250) AS removed, min(id) FILTER (WHERE id >= 250) AS first_kept FROM l GROUP BY list_no")
def _(spark, sf):
    v = vectors(spark, sf)
    gone = F.col("id") < 250
    return ivf.build(v, pinned(v)).groupBy("list_no").agg(F.count_if(gone).alias("removed"), F.min(F.when(~gone, F.col("id"))).alias("first_kept"))


@query("a16_lists_with_payload", f"WITH {L} SELECT list_no, row_number() OVER (PARTITION BY list_no ORDER BY id) - 1 AS place, id, round(o2c, 6) AS o2c FROM l")
def _(spark, sf):
    v = vectors(spark, sf)
    place = F.row_number().over(Window.partitionBy("list_no").orderBy("id")) - 1
    return rounded(ivf.build(v, pinned(v)).select("list_no", place.cast("long").alias("place"), "id", "o2c"), "o2c")


@query("a17_self_excluding_scores", f"WITH {S_CODED}, f AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dis, id) AS r FROM d WHERE abs(id - qid) > 16) SELECT qid, round(var_pop(dis + q2c - o2c), 4) AS score FROM f WHERE r <= 5 GROUP BY qid")
def _(spark, sf):
    c = coded_candidates(vectors(spark, sf)).where("abs(id - qid) > 16")
    return knn.top_k(c, 5).groupBy("qid").agg(F.round(F.var_pop(F.col("dis") + F.col("q2c") - F.col("o2c")), 4).alias("score"))


@query("a19_preassigned_scan", f"WITH {L}, y AS (SELECT * FROM pr WHERE probe <= 2) " + s_top(S_CAND.replace("FROM pr q", "FROM y q") + " WHERE abs(x.id - q.qid) > 16"))
def _(spark, sf):
    v = vectors(spark, sf)
    given = probed(v).where("probe <= 2")
    c = ivf.candidates(given, ivf.build(v, pinned(v)), zone=16)
    return rounded(knn.top_k(c.select("qid", "id", distances.l2(F.col("qvec"), F.col("vec")).alias("dis")), 5).select("qid", "rank", "id", "dis"))


S_TWO = f"""{V}, {s_pinned(NLIST)}, {s_pinned(6, 2).replace('c AS', 'n AS')}, h AS (SELECT * FROM v WHERE id % 2 = 0), b AS (SELECT * FROM v WHERE id % 2 = 1),
la AS (SELECT x.id, x.vec, q.list_no FROM c q, h x QUALIFY row_number() OVER (PARTITION BY x.id ORDER BY {s_l2('q.vec', 'x.vec')}, q.list_no) = 1),
lb AS (SELECT x.id, x.vec, q.list_no FROM n q, b x QUALIFY row_number() OVER (PARTITION BY x.id ORDER BY {s_l2('q.vec', 'x.vec')}, q.list_no) = 1),
pa AS (SELECT x.id AS qid, x.vec AS qvec, q.list_no FROM c q, v x WHERE x.id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY x.id ORDER BY {s_l2('q.vec', 'x.vec')}, q.list_no) <= 3),
pb AS (SELECT x.id AS qid, x.vec AS qvec, q.list_no FROM n q, v x WHERE x.id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY x.id ORDER BY {s_l2('q.vec', 'x.vec')}, q.list_no) <= 3),
z AS (SELECT q.qid, x.id, 'batch' AS part, {s_l2('q.qvec', 'x.vec')} AS dis FROM pb q JOIN lb x ON q.list_no = x.list_no UNION ALL SELECT q.qid, x.id, 'old', {s_l2('q.qvec', 'x.vec')} FROM pa q JOIN la x ON q.list_no = x.list_no)"""


def _two(v: DataFrame) -> DataFrame:
    """Candidates of two indexes, each with centroids of its own: older entries and those of a batch."""
    out = None
    for rows, c, part in ((v.where("id % 2 = 1"), models.pinned_centroids(v, 6, 2), "batch"), (v.where("id % 2 = 0"), pinned(v), "old")):
        found = ivf.candidates(ivf.probes(few(v), c, 3), ivf.build(rows, c)).select("qid", "id", F.lit(part).alias("part"), distances.l2(F.col("qvec"), F.col("vec")).alias("dis"))
        out = found if out is None else out.unionByName(found)
    return out


@query("a21_two_index_search", f"WITH {S_TWO} " + s_top("SELECT * FROM z"))
def _(spark, sf):
    return rounded(knn.top_k(_two(vectors(spark, sf)), 5).select("qid", "rank", "id", "dis"))


@query("a22_two_index_scan_order", f"WITH {S_TWO} SELECT qid, part, count(*) AS n, round(min(dis), 6) AS least FROM z GROUP BY ALL")
def _(spark, sf):
    return _two(vectors(spark, sf)).groupBy("qid", "part").agg(F.count("*").alias("n"), F.round(F.min("dis"), 6).alias("least"))


@query("a23_pq_list_scan", f"WITH {S_CODED} SELECT qid, list_no, count(*) AS n, round(min(dis), 4) AS least, round(max(dis), 4) AS most FROM d GROUP BY qid, list_no")
def _(spark, sf):
    return coded_candidates(vectors(spark, sf)).groupBy("qid", "list_no").agg(F.count("*").alias("n"), F.round(F.min("dis"), 4).alias("least"), F.round(F.max("dis"), 4).alias("most"))


@query("a24_pruned_scan", f"""WITH {L}, z AS ({S_CAND.replace('x.id,', 'x.id, q.q2c, x.o2c,')}), t AS (SELECT qid, max(dis) AS cut FROM (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY qid ORDER BY dis, id) <= 5) GROUP BY qid)
SELECT z.qid, count(*) AS n, count(*) FILTER (WHERE power(sqrt(q2c) - sqrt(o2c), 2) > cut) AS pruned, count(*) FILTER (WHERE power(sqrt(q2c) - sqrt(o2c), 2) > cut AND dis < cut) AS lost FROM z JOIN t ON z.qid = t.qid GROUP BY z.qid""")
def _(spark, sf):
    """What the triangle inequality spares at the final threshold; it loses nothing."""
    v = vectors(spark, sf)
    c = ivf.candidates(probed(v), ivf.build(v, pinned(v))).select("qid", "id", "q2c", "o2c", distances.l2(F.col("qvec"), F.col("vec")).alias("dis"))
    cut = knn.top_k(c, 5).groupBy("qid").agg(F.max("dis").alias("cut"))
    spared = F.pow(F.sqrt("q2c") - F.sqrt("o2c"), 2) > F.col("cut")
    return c.join(cut, "qid").groupBy("qid").agg(F.count("*").alias("n"), F.count_if(spared).alias("pruned"), F.count_if(spared & (F.col("dis") < F.col("cut"))).alias("lost"))


@query("a25_inner_product_tables", f"WITH {CB} SELECT q.id AS qid, q.m, x.code, round({s_ip('q.sub', 'x.sub')}, 6) AS ip FROM sv q JOIN cb x ON q.m = x.m WHERE q.id % 50 = 0")
def _(spark, sf):
    v = vectors(spark, sf)
    t = quantizers.tables(few(v), book(v), "ip").select("qid", F.posexplode("lut").alias("m", "row"))
    return t.select("qid", F.col("m").cast("long").alias("m"), F.posexplode("row").alias("code", "ip")).withColumn("ip", F.round("ip", 6))


@query("a26_scan_by_inner_product", f"WITH {L} " + s_top(S_CAND.replace(s_l2("q.qvec", "x.vec"), s_ip("q.qvec", "x.vec")), desc=True))
def _(spark, sf):
    v = vectors(spark, sf)
    c = pinned(v)
    return rounded(ivf.search(few(v), ivf.build(v, c), c, 5, NPROBE, "ip"))


@query("a27_top_k_with_payload", f"WITH {L} " + s_top(S_CAND.replace("x.id,", "x.id, x.o2c,"), keep=", round(o2c, 6) AS o2c"))
def _(spark, sf):
    v = vectors(spark, sf)
    c = ivf.candidates(probed(v), ivf.build(v, pinned(v))).select("qid", "id", "o2c", distances.l2(F.col("qvec"), F.col("vec")).alias("dis"))
    return rounded(knn.top_k(c, 5).select("qid", "rank", "id", "dis", "o2c"), "dis", "o2c")


@query("a35_score_order", "SELECT event_id AS id, value AS score FROM events ORDER BY value DESC, event_id LIMIT 100")
def _(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select(F.col("event_id").alias("id"), F.col("value").alias("score")).orderBy(F.desc("score"), "id").limit(100)


@query("a36_coarse_quantizer", f"WITH {A} SELECT id, list_no, CAST(rank AS INTEGER) AS rank, round(dis, 6) AS dis FROM a WHERE rank <= 3")
def _(spark, sf):
    v = vectors(spark, sf)
    return rounded(models.assign(v, pinned(v), 3).select("id", "list_no", "rank", "dis"))


@query("a37_self_test", f"WITH {L} SELECT qid, id = qid AS own FROM ({s_top(S_CAND, 1)})")
def _(spark, sf):
    v = vectors(spark, sf)
    c = pinned(v)
    return ivf.search(few(v), ivf.build(v, c), c, 1, NPROBE).select("qid", (F.col("id") == F.col("qid")).alias("own"))


# Sources.


def _stored(spark, lists: DataFrame, **model) -> tuple[dict, DataFrame, dict]:
    path = f"{_scratch(spark)}/index"
    vector_files.save_index(path, {"nlist": NLIST}, lists, **model)
    return vector_files.load_index(spark, path)


@query("s02_s03_index_round_trip", f"WITH {L} " + s_top(S_CAND))
def _(spark, sf):
    v = vectors(spark, sf)
    _, lists, model = _stored(spark, ivf.build(v, pinned(v)), centroids=pinned(v))
    return rounded(ivf.search(few(v), lists, model["centroids"], 5, NPROBE))


@query("s04_binary_round_trip", f"WITH {BIN} SELECT id, bits FROM b")
def _(spark, sf):
    _, lists, _ = _stored(spark, codes32(vectors(spark, sf)).withColumn("list_no", F.lit(0)))
    return lists.select("id", binary.unpack(F.col("code"), 64).alias("bits"))


@query("s05_model_round_trip", f"WITH {CB} SELECT CAST(m AS INTEGER) AS m, code, list_transform(sub, lambda x: round(x, 9)) AS sub FROM cb")
def _(spark, sf):
    v = vectors(spark, sf)
    _, _, model = _stored(spark, ivf.build(v, pinned(v)), codebook=book(v))
    b = model["codebook"]
    return spark.createDataFrame([(m, c, [round(float(x), 9) for x in b[m, c]]) for m in range(M) for c in range(CODES)], "m int, code int, sub array<double>")


@query("s07_records_round_trip", f"WITH {V} SELECT id, round({s_ip('vec', 'vec')}, 6) AS n2 FROM v")
def _(spark, sf):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf.id, "vec": [vector_files.parse(bytes(r), "fvecs")[0].astype(float) for r in pdf.record]})

    back = vector_files.to_records(vectors(spark, sf)).mapInPandas(run, "id long, vec array<double>")
    return back.select("id", F.round(distances.norm2(F.col("vec")), 6).alias("n2"))


@query("s11_merged_shards", "SELECT CASE WHEN vec_id % 2 = 0 THEN vec_id ELSE vec_id + (SELECT max(vec_id) FILTER (WHERE vec_id % 2 = 0) + 1 FROM embeddings) END AS id, label FROM embeddings")
def _(spark, sf):
    v = vectors(spark, sf, "label").select("id", "label")
    return vector_files.merge_shards([v.where("id % 2 = 0"), v.where("id % 2 = 1")])


@query("s13_dataset_parts", "SELECT CAST(ntile(4) OVER (ORDER BY vec_id) - 1 AS INTEGER) AS part, vec_id AS id FROM embeddings")
def _(spark, sf):
    return vector_files.split(vectors(spark, sf), 4).select("part", "id")


# Parameters, selectors, codecs.


@query("p06_selector_through_id_map", "SELECT vec_id AS id, vec_id * 7 + 1 AS external FROM embeddings WHERE (vec_id * 7 + 1) % 3 = 0")
def _(spark, sf):
    return vectors(spark, sf).select("id", (F.col("id") * 7 + 1).alias("external")).where("external % 3 = 0")


@query("p07_callback_selector", "SELECT vec_id AS id FROM embeddings WHERE vec_id % 9 IN (2, 5)")
def _(spark, sf):
    @F.pandas_udf("boolean")
    def wanted(ids: pd.Series) -> pd.Series:
        return ids.mod(9).isin([2, 5])

    return vectors(spark, sf).select("id").where(wanted("id"))


@query("p08_parameters_of_each_search", f"WITH {L} " + s_top(S_CAND + " WHERE q.probe <= 1 + q.qid / 50 % 4"))
def _(spark, sf):
    v = vectors(spark, sf)
    own = probed(v).where(F.col("probe") <= 1 + F.col("qid") / 50 % 4)
    c = ivf.candidates(own, ivf.build(v, pinned(v)))
    return rounded(knn.top_k(c.select("qid", "id", distances.l2(F.col("qvec"), F.col("vec")).alias("dis")), 5).select("qid", "rank", "id", "dis"))


S_DECODED = "y AS (SELECT id, flatten(list(cb.sub ORDER BY cb.m)) AS vec FROM e JOIN cb ON cb.m = e.m AND cb.code = e.code GROUP BY id)"


@query("p09_reconstructed", f"WITH {CB}, {S_DECODED} SELECT id, list_transform(vec, lambda x: round(x, 9)) AS vec FROM y")
def _(spark, sf):
    v = vectors(spark, sf)
    return quantizers.encode_pq(v, book(v)).select("id", F.transform(quantizers.decode_pq(F.col("code"), book(v)), lambda x: F.round(x, 9)).alias("vec"))


@query("p10_reconstructed_by_place", f"WITH {L}, o AS (SELECT list_no, row_number() OVER (PARTITION BY list_no ORDER BY id) - 1 AS place, id, vec FROM l) SELECT list_no, place, id, round({s_ip('vec', 'vec')}, 6) AS n2 FROM o WHERE place % 5 = 0")
def _(spark, sf):
    v = vectors(spark, sf)
    place = (F.row_number().over(Window.partitionBy("list_no").orderBy("id")) - 1).cast("long")
    return ivf.build(v, pinned(v)).withColumn("place", place).where("place % 5 = 0").select("list_no", "place", "id", F.round(distances.norm2(F.col("vec")), 6).alias("n2"))


@query("p12_codec_error", f"WITH {CB}, {S_DECODED} SELECT y.id, round({s_l2('v.vec', 'y.vec')}, 6) AS err FROM y JOIN v ON v.id = y.id")
def _(spark, sf):
    v = vectors(spark, sf)
    b = book(v)
    return quantizers.encode_pq(v, b).select("id", F.round(distances.l2(F.col("vec"), quantizers.decode_pq(F.col("code"), b)), 6).alias("err"))


def _packed(code):
    """4-bit codes, two to a byte, the first in the low half, as hex digits."""
    pairs = F.transform(F.sequence(F.lit(0), F.lit(M // 2 - 1)), lambda i: F.lpad(F.hex((F.get(code, 2 * i) + 16 * F.get(code, 2 * i + 1)).cast("long")), 2, "0"))
    return F.concat_ws("", pairs)


S_PACKED = f"SELECT id, string_agg(printf('%02X', lo + 16 * hi), '' ORDER BY m) AS packed FROM (SELECT a.id, a.m, a.code AS lo, b.code AS hi FROM e a JOIN e b ON a.id = b.id AND b.m = a.m + 1 WHERE a.m % 2 = 0) GROUP BY id"


@query("q09_packed_codes", f"WITH {CB} {S_PACKED}")
def _(spark, sf):
    v = vectors(spark, sf)
    return quantizers.encode_pq(v, book(v)).select("id", _packed(F.col("code")).alias("packed"))


@query("p15_list_number_and_code", f"WITH {LC}, z AS ({S_PACKED}) SELECT z.id, printf('%04X', l.list_no) || z.packed AS record FROM z JOIN l ON l.id = z.id")
def _(spark, sf):
    return coded_lists(vectors(spark, sf)).select("id", F.concat(F.lpad(F.hex(F.col("list_no").cast("long")), 4, "0"), _packed(F.col("code"))).alias("record"))


@query("p17_permuted_entries", "SELECT (SELECT max(vec_id) FROM embeddings) - vec_id AS id, label FROM embeddings")
def _(spark, sf):
    v = vectors(spark, sf, "label")
    return v.crossJoin(F.broadcast(v.agg(F.max("id").alias("top")))).select((F.col("top") - F.col("id")).alias("id"), "label")


@query("p18_inspected_lists", f"WITH {L} SELECT list_no, list(id ORDER BY id) AS ids FROM l GROUP BY list_no")
def _(spark, sf):
    v = vectors(spark, sf)
    return ivf.build(v, pinned(v)).groupBy("list_no").agg(F.array_sort(F.collect_list("id")).alias("ids"))


# Searches.


def _recall(found: DataFrame, v: DataFrame, least: float) -> DataFrame:
    """Does the exact nearest vector (itself, for stored queries) come among the found at least so often?"""
    return evaluation.recall_at(found, knn.exact_knn(few(v), v, 1), 10).select((F.col("recall") >= least).alias("enough"))


@query("j15_ivf_residual_quantizer_recall", "SELECT true AS enough")
def _(spark, sf):
    v = vectors(spark, sf)
    c = pinned(v)
    b = quantizers.train_rq(models.pinned_centroids(v, 256), 4, 16)
    codes = quantizers.encode_additive(v, b).select("id", quantizers.decode_additive(F.col("code"), b).alias("vec"))
    lists = ivf.build(v, c).select("list_no", "id").join(codes, "id")
    return _recall(ivf.search(few(v), lists, c, 10, NPROBE), v, 0.5)


@query("j22_additive_coarse_quantizer", f"""WITH {V}, {s_pinned(8)}, {s_pinned(4, 2).replace('c AS', 'n AS')}, g AS (SELECT CAST(c.list_no + 8 * n.list_no AS INTEGER) AS list_no, list_transform(list_zip(c.vec, n.vec), lambda p: p[1] + 0.5 * p[2]) AS vec FROM c, n)
SELECT x.id, g.list_no, round({s_l2('g.vec', 'x.vec')}, 6) AS dis FROM g, v x QUALIFY row_number() OVER (PARTITION BY x.id ORDER BY {s_l2('g.vec', 'x.vec')}, g.list_no) = 1""")
def _(spark, sf):
    """Centroids are sums of one entry of each of two books; none of the sums is stored."""
    v = vectors(spark, sf)
    a, b = models.pinned_centroids(v, 8), 0.5 * models.pinned_centroids(v, 4, 2)
    grid = (b[:, None, :] + a[None, :, :]).reshape(-1, a.shape[1])
    return rounded(models.assign(v, grid).select("id", "list_no", "dis"))


@query("j29_two_layer_storage", f"WITH {LC}, k AS (SELECT id, list(code ORDER BY m) AS code FROM e GROUP BY id) SELECT l.id, l.list_no, k.code FROM l JOIN k ON k.id = l.id")
def _(spark, sf):
    return coded_lists(vectors(spark, sf)).select("id", "list_no", "code")


@query("j32_four_bit_search_refined", f"WITH {S_CODED}, f AS ({s_top('SELECT * FROM d', 20)}) " + s_top(f"SELECT f.qid, f.id, {S_METRICS['l2']} AS dis FROM f JOIN v q ON q.id = f.qid JOIN v x ON x.id = f.id"))
def _(spark, sf):
    v = vectors(spark, sf)
    return rounded(knn.refine(knn.top_k(coded_candidates(v), 20), v, v, 5))


@query("j36_random_results", "SELECT * FROM (SELECT q.vec_id AS qid, x.vec_id AS id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY md5(CAST(q.vec_id AS VARCHAR) || ':' || CAST(x.vec_id AS VARCHAR)), x.vec_id) AS INTEGER) AS rank FROM embeddings q, embeddings x WHERE q.vec_id % 50 = 0) WHERE rank <= 5")
def _(spark, sf):
    v = vectors(spark, sf).select("id")
    p = v.crossJoin(F.broadcast(few(v).select(F.col("id").alias("qid"))))
    order = F.row_number().over(Window.partitionBy("qid").orderBy(F.md5(F.concat_ws(":", "qid", "id")), "id"))
    return p.withColumn("rank", order).where("rank <= 5").select("qid", "id", "rank")


@query("j45_centroid_search", f"WITH {L} SELECT qid, CAST(probe AS INTEGER) AS probe, list_no, round(q2c, 6) AS q2c FROM pr")
def _(spark, sf):
    return rounded(probed(vectors(spark, sf)).select("qid", "probe", "list_no", "q2c"), "q2c")


@query("j47_lists_in_shards", f"WITH {L} " + s_top(S_CAND))
def _(spark, sf):
    """Each server holds every third list and searches the probes that fall there."""
    v = vectors(spark, sf)
    lists, p, out = ivf.build(v, pinned(v)), probed(v), None
    for i in range(3):
        c = ivf.candidates(p.where(F.col("list_no") % 3 == i), lists.where(F.col("list_no") % 3 == i))
        found = knn.top_k(c.select("qid", "id", distances.l2(F.col("qvec"), F.col("vec")).alias("dis")), 5).select("qid", "id", "dis")
        out = found if out is None else out.unionByName(found)
    return rounded(knn.top_k(out, 5).select("qid", "rank", "id", "dis"))


@query("j48_ground_truth_by_blocks", f"WITH {V} " + s_top(ALL_PAIRS, dis="round(dis, 4)"))
def _(spark, sf):
    v = vectors(spark, sf)
    return rounded(knn.blocked_knn(few(v), v, 5, block=7, shards=3), digits=4)


@query("j49_one_shot_knn", f"WITH {V} " + s_top(f"SELECT q.id AS qid, x.id, {S_METRICS['ip']} AS dis FROM v q, v x WHERE q.id % 50 = 0", 10, desc=True, dis="round(dis, 4)"))
def _(spark, sf):
    v = vectors(spark, sf)
    return rounded(knn.blocked_knn(few(v), v, 10, "ip"), digits=4)


@query("j50_offline_pipeline", f"WITH {L} " + s_top(S_CAND))
def _(spark, sf):
    """Shards are indexed apart over one set of centroids, stored, loaded, merged and searched."""
    v = vectors(spark, sf)
    c, merged = pinned(v), None
    for i in range(2):
        _, lists, _ = _stored(spark, ivf.build(v.where(F.col("id") % 2 == i), c))
        merged = lists if merged is None else ivf.merge_lists(merged, lists)
    return rounded(ivf.search(few(v), merged, c, 5, NPROBE))


# Ranges.


@query("r03_range_by_codes", S_ADC + "SELECT qid, id, round(dis, 4) AS dis FROM p WHERE dis < 0.9")
def _(spark, sf):
    v = vectors(spark, sf)
    found = quantizers.search_pq(few(v), quantizers.encode_pq(v, book(v)), book(v), 1 << 30)
    return rounded(found.where("dis < 0.9").select("qid", "id", "dis"), digits=4)


@query("r07_range_by_shards", f"WITH {V}, p AS ({ALL_PAIRS}) SELECT qid, id, round(dis, 6) AS dis FROM p WHERE dis < 1.5")
def _(spark, sf):
    v = vectors(spark, sf)
    parts = [knn.range_search(few(v), v.where(F.col("id") % 3 == i), 1.5) for i in range(3)]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query("r08_range_by_knn_then_all", f"WITH {V}, p AS ({ALL_PAIRS}) SELECT qid, id, round(dis, 6) AS dis FROM p WHERE dis < 1.4")
def _(spark, sf):
    """A first k-NN answers queries whose k-th neighbour lies outside; only the others are searched whole."""
    v = vectors(spark, sf)
    first = knn.exact_knn(few(v), v, 8)
    open_ = first.groupBy("qid").agg(F.max("dis").alias("last")).where("last < 1.4").select(F.col("qid").alias("id"))
    rest = knn.range_search(few(v).join(open_, "id"), v, 1.4)
    done = first.join(open_.select(F.col("id").alias("qid")), "qid", "left_anti").where("dis < 1.4").select("qid", "id", "dis")
    return rounded(done.unionByName(rest))


@query("r10_smaller_radius", f"WITH {V}, p AS ({ALL_PAIRS}) SELECT qid, count(*) AS n FROM p WHERE dis < 1.2 GROUP BY qid")
def _(spark, sf):
    v = vectors(spark, sf)
    return knn.range_search(few(v), v, 1.5).where("dis < 1.2").groupBy("qid").agg(F.count("*").alias("n"))


# Heaps and sorting.


@query("k01_best_of_each_query", f"WITH {V} " + s_top(ALL_PAIRS, 1))
def _(spark, sf):
    v = vectors(spark, sf)
    best = knn.pairs(few(v), v).groupBy("qid").agg(F.min(F.struct("dis", "id")).alias("b"))
    return best.select("qid", F.lit(1).alias("rank"), "b.id", F.round("b.dis", 6).alias("dis"))


@query("k02_most_similar", f"WITH {V} " + s_top(f"SELECT q.id AS qid, x.id, {S_METRICS['ip']} AS dis FROM v q, v x WHERE q.id % 50 = 0", 7, desc=True))
def _(spark, sf):
    v = vectors(spark, sf)
    return rounded(knn.exact_knn(few(v), v, 7, "ip"))


@query("k03_indirect_order", f"WITH {V}, u AS (SELECT id, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS pos FROM v) SELECT id, list(pos ORDER BY x, pos)[1:4] AS least FROM u GROUP BY id")
def _(spark, sf):
    """Positions of a vector's four smallest components."""
    pairs = F.array_sort(F.transform(F.col("vec"), lambda x, i: F.struct(x.cast("double").alias("x"), i.cast("long").alias("i"))))
    return vectors(spark, sf).select("id", F.transform(F.slice(pairs, 1, 4), lambda p: p["i"]).alias("least"))


@query("k05_results_batch_by_batch", f"WITH {V} " + s_top(ALL_PAIRS, 6))
def _(spark, sf):
    v = vectors(spark, sf)
    best = None
    for i in range(4):
        more = knn.exact_knn(few(v), v.where(F.col("id") % 4 == i), 6).drop("rank")
        best = more if best is None else knn.top_k(best.unionByName(more), 6).select("qid", "id", "dis")
    return rounded(knn.top_k(best, 6).select("qid", "rank", "id", "dis"))


@query("k06_large_k", f"WITH {V} " + s_top(ALL_PAIRS, 150, dis="round(dis, 5)"))
def _(spark, sf):
    v = vectors(spark, sf)
    return rounded(knn.exact_knn(few(v), v, 150), digits=5)


@query("k10_argsort", f"WITH {V}, u AS (SELECT id, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS pos FROM v) SELECT id, list(pos ORDER BY x DESC, pos) AS places FROM u GROUP BY id")
def _(spark, sf):
    pairs = F.array_sort(F.transform(F.col("vec"), lambda x, i: F.struct((-x.cast("double")).alias("x"), i.cast("long").alias("i"))))
    return vectors(spark, sf).select("id", F.transform(pairs, lambda p: p["i"]).alias("places"))


@query("k12_bucketed_top_k", f"WITH {V}, p AS ({ALL_PAIRS}), b AS (SELECT qid, id, dis FROM p QUALIFY row_number() OVER (PARTITION BY qid, id % 32 ORDER BY dis, id) = 1) " + s_top("SELECT * FROM b"))
def _(spark, sf):
    """The least of each bucket of ids, then the best of those."""
    v = vectors(spark, sf)
    b = knn.pairs(few(v), v).groupBy("qid", (F.col("id") % 32).alias("bucket")).agg(F.min(F.struct("dis", "id")).alias("b"))
    return rounded(knn.top_k(b.select("qid", "b.id", "b.dis"), 5).select("qid", "rank", "id", "dis"))


@query("k13_ties", f"WITH {BIN}, p AS (SELECT q.id AS qid, x.id, CAST({S_HAM} AS INTEGER) AS dis FROM b q, b x WHERE q.id % 50 = 0) SELECT * FROM (SELECT qid, id, dis, CAST(dense_rank() OVER (PARTITION BY qid ORDER BY dis) AS INTEGER) AS class FROM p) WHERE class <= 4")
def _(spark, sf):
    c = codes32(vectors(spark, sf))
    p = binary.pairs(few(c), c).withColumn("dis", F.col("dis").cast("int"))
    return p.select("qid", "id", "dis", F.dense_rank().over(Window.partitionBy("qid").orderBy("dis")).alias("class")).where("class <= 4")


@query("k14_merged_with_labels", f"WITH {V}, p AS ({ALL_PAIRS}), f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY qid ORDER BY dis, id) <= 5), m AS (SELECT qid, id + 1000 AS id, dis FROM f UNION ALL SELECT qid, id, dis FROM f) " + s_top("SELECT * FROM m"))
def _(spark, sf):
    v = vectors(spark, sf)
    f = knn.exact_knn(few(v), v, 5).drop("rank")
    return rounded(knn.top_k(f.withColumn("id", F.col("id") + 1000).unionByName(f), 5).select("qid", "rank", "id", "dis"))


@query("k15_sorted_ranges", f"WITH {V}, p AS ({ALL_PAIRS}) SELECT qid, list(id ORDER BY id) AS by_id, list(id ORDER BY dis, id) AS by_distance FROM p WHERE dis < 1.4 GROUP BY qid")
def _(spark, sf):
    v = vectors(spark, sf)
    r = knn.range_search(few(v), v, 1.4).groupBy("qid").agg(F.array_sort(F.collect_list("id")).alias("by_id"), F.array_sort(F.collect_list(F.struct("dis", "id"))).alias("b"))
    return r.select("qid", "by_id", F.transform("b", lambda x: x["id"]).alias("by_distance"))


# Aggregates and training.


@query("g10_distinct_by_codec", f"WITH {CB}, k AS (SELECT id, list(code ORDER BY m) AS code FROM e WHERE m < 3 GROUP BY id) SELECT min(id) AS id, count(*) AS copies FROM k GROUP BY code")
def _(spark, sf):
    v = vectors(spark, sf)
    c = quantizers.encode_pq(v, book(v)).select("id", F.slice("code", 1, 3).alias("code"))
    return c.groupBy("code").agg(F.min("id").alias("id"), F.count("*").alias("copies")).select("id", "copies")


@query("g11_checksums", "SELECT vec_id AS id, md5(CAST(vec_id AS VARCHAR) || '/' || CAST(label AS VARCHAR)) AS digest FROM embeddings")
def _(spark, sf):
    return vectors(spark, sf, "label").select("id", F.md5(F.concat_ws("/", "id", "label")).alias("digest"))


@query("g12_search_statistics", f"WITH {L} SELECT pr.qid, count(DISTINCT pr.list_no) AS lists, count(*) AS codes FROM pr JOIN l ON l.list_no = pr.list_no GROUP BY pr.qid")
def _(spark, sf):
    v = vectors(spark, sf)
    sizes = ivf.list_statistics(ivf.build(v, pinned(v))).select("list_no", "size")
    return probed(v).join(sizes, "list_no").groupBy("qid").agg(F.count("*").alias("lists"), F.sum("size").alias("codes"))


@query("g15_component_ranges", f"WITH {V}, u AS (SELECT unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS pos FROM v) SELECT CAST(pos AS INTEGER) AS pos, round(min(x), 9) AS least, round(max(x), 9) AS most, round(avg(x), 8) AS mean, round(stddev_pop(x), 8) AS sd FROM u GROUP BY pos")
def _(spark, sf):
    x = vectors(spark, sf).select(F.posexplode(F.col("vec").cast("array<double>")).alias("pos", "x"))
    return x.groupBy("pos").agg(F.round(F.min("x"), 9).alias("least"), F.round(F.max("x"), 9).alias("most"), F.round(F.avg("x"), 8).alias("mean"), F.round(F.stddev_pop("x"), 8).alias("sd"))


@query("g16_neighbour_variance", f"WITH {V}, p AS ({ALL_PAIRS} AND q.id <> x.id), f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY qid ORDER BY dis, id) <= 8) SELECT qid, round(var_pop(dis), 7) AS variance FROM f GROUP BY qid")
def _(spark, sf):
    v = vectors(spark, sf)
    return knn.exact_knn(few(v), v, 8, exclude_self=True).groupBy("qid").agg(F.round(F.var_pop("dis"), 7).alias("variance"))


@query("c03_update_from_codes", f"""WITH {CB}, {S_DECODED}, c AS (SELECT code AS list_no, vec FROM k0), a AS (SELECT y.id, y.vec, c.list_no FROM c, y QUALIFY row_number() OVER (PARTITION BY y.id ORDER BY round({s_l2('c.vec', 'y.vec')}, 9), c.list_no) = 1),
u AS (SELECT list_no, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS pos FROM a) SELECT list_no, CAST(pos AS INTEGER) AS pos, round(avg(x), 7) AS x FROM u GROUP BY ALL""")
def _(spark, sf):
    """One k-means round over vectors decoded block by block from their codes."""
    v = vectors(spark, sf)
    y = quantizers.encode_pq(v, book(v)).select("id", quantizers.decode_pq(F.col("code"), book(v)).alias("vec"))
    c = models.centroid_update(models.assign(y, pinned(v)))
    return c.select("list_no", F.posexplode("vec").alias("pos", "x")).withColumn("x", F.round("x", 7))


@query("c06_training_lowers_error", "SELECT true AS lower")
def _(spark, sf):
    v = vectors(spark, sf)
    _, stats = models.kmeans(v, NLIST, 6)
    return spark.createDataFrame([(stats[-1]["objective"] < stats[0]["objective"],)], "lower boolean")


@query("q02_trained_codebook_is_better", "SELECT true AS better")
def _(spark, sf):
    v = vectors(spark, sf)
    error = lambda b: quantizers.encode_pq(v, b).agg(F.avg(distances.l2(F.col("vec"), quantizers.decode_pq(F.col("code"), b)))).first()[0]
    return spark.createDataFrame([(error(quantizers.train_pq(v, M, CODES, 8)) < error(book(v)),)], "better boolean")


@query("q06_pq_inner_products", f"WITH {CB}, i AS (SELECT q.id, q.m, x.code, {s_ip('q.sub', 'x.sub')} AS dis FROM sv q JOIN cb x ON q.m = x.m WHERE q.id % 50 = 0), p AS (SELECT i.id AS qid, e.id, sum(i.dis) AS dis FROM i JOIN e ON i.m = e.m AND i.code = e.code GROUP BY 1, 2) SELECT qid, count(*) AS n, round(max(dis), 4) AS most FROM p GROUP BY qid")
def _(spark, sf):
    v = vectors(spark, sf)
    all_ = quantizers.search_pq(few(v), quantizers.encode_pq(v, book(v)), book(v), 1 << 30, "ip")
    return all_.groupBy("qid").agg(F.count("*").alias("n"), F.round(F.max("dis"), 4).alias("most"))


@query("q08_codes_from_tables", f"WITH {CB} SELECT id, list(code ORDER BY m) AS code FROM e WHERE id % 50 = 0 GROUP BY id")
def _(spark, sf):
    v = vectors(spark, sf)
    nearest = lambda row: (F.array_position(row, F.array_min(row)) - 1).cast("int")
    return quantizers.tables(few(v), book(v)).select(F.col("qid").alias("id"), F.transform("lut", nearest).alias("code"))


@query("q13_residual_steps_lower_error", "SELECT true AS lower")
def _(spark, sf):
    v = vectors(spark, sf)
    x = models.pinned_centroids(v, 256)
    error = lambda b: quantizers.encode_additive(v, b).agg(F.avg(distances.l2(F.col("vec"), quantizers.decode_additive(F.col("code"), b)))).first()[0]
    return spark.createDataFrame([(error(quantizers.train_rq(x, 4, 16)) < error(quantizers.train_rq(x, 2, 16)),)], "lower boolean")


@query("t02_linear_map", f"WITH {V} SELECT id, list_transform(range(64), lambda j: round(vec[j + 1] + 2 * vec[(j + 1) % 64 + 1] + 0.5, 7)) AS vec FROM v")
def _(spark, sf):
    a = np.eye(64) + 2 * np.roll(np.eye(64), 1, axis=1)
    return transforms.apply_linear(vectors(spark, sf), a, np.full(64, 0.5)).select("id", F.transform("vec", lambda x: F.round(x, 7)).alias("vec"))


@query("t01_transform_reversed", f"WITH {V} SELECT id, list_transform(vec, lambda x: round(x, 6)) AS vec FROM v")
def _(spark, sf):
    r, b = transforms.random_rotation(64, 64), np.arange(64) / 64
    back = transforms.reverse_linear(transforms.apply_linear(vectors(spark, sf), r, b), r, b)
    noise = 1e-13 * (1 + F.array_max(F.transform("vec", F.abs)))  # a component within it is 0
    # in the type of the vectors that went in: the last bits, which two rotations move, are no part of it
    digits = lambda x: F.round(x.cast("float").cast("double"), 6)
    # DuckDB's round keeps the sign of what becomes 0, Spark's does not
    return back.select("id", F.transform("vec", lambda x: F.when((digits(x) == 0) & (x < -noise), F.lit(-0.0)).otherwise(digits(x))).alias("vec"))


@query("t04_pca_keeps_most", "SELECT true AS ordered, true AS centred")
def _(spark, sf):
    v = vectors(spark, sf)
    a, b = transforms.pca(v, 8)
    _, mean, cov = transforms.moments(transforms.apply_linear(v, a, b))
    d = np.diag(cov)
    return spark.createDataFrame([(bool((np.diff(d) <= 1e-9).all()), bool(np.abs(mean).max() < 1e-6))], "ordered boolean, centred boolean")


# Updates.


@query("u08_replicas", f"WITH {V} " + s_top(ALL_PAIRS))
def _(spark, sf):
    """Queries are split among copies of one index."""
    v = vectors(spark, sf)
    parts = [knn.exact_knn(few(v).where(F.col("id") / 50 % 2 == i), v, 5) for i in range(2)]
    return rounded(parts[0].unionByName(parts[1]))


@query("u12_lists_as_arrays", f"WITH {L} SELECT list_no, count(*) AS size, min(id) AS first_id, max(id) AS last_id FROM l GROUP BY list_no")
def _(spark, sf):
    v = vectors(spark, sf)
    ids = F.array_sort(F.collect_list("id"))
    out = ivf.build(v, pinned(v)).groupBy("list_no").agg(ids.alias("ids"))
    return out.select("list_no", F.size("ids").cast("long").alias("size"), F.element_at("ids", 1).alias("first_id"), F.element_at("ids", -1).alias("last_id"))


@query("u14_common_results", f"WITH {V}, p AS ({ALL_PAIRS}), i AS (SELECT q.id AS qid, x.id, {S_METRICS['l1']} AS dis FROM v q, v x WHERE q.id % 50 = 0), f AS ({s_top('SELECT * FROM p', 10)}), g AS ({s_top('SELECT * FROM i', 10)}) SELECT count(*) AS common FROM f JOIN g ON f.qid = g.qid AND f.id = g.id")
def _(spark, sf):
    v = vectors(spark, sf)
    a, b = (knn.exact_knn(few(v), v, 10, m).select("qid", "id") for m in ("l2", "l1"))
    return a.join(b, ["qid", "id"]).agg(F.count("*").alias("common"))


# Functions.


@query("f01_distances_of_pairs", f"WITH {V} SELECT q.id, round({S_METRICS['l2']}, 6) AS l2, round({S_METRICS['ip']}, 6) AS ip, round({S_METRICS['l1']}, 6) AS l1, round({S_METRICS['linf']}, 6) AS linf FROM v q JOIN v x ON x.id = q.id + 1")
def _(spark, sf):
    v = vectors(spark, sf)
    p = v.join(v.select((F.col("id") - 1).alias("id"), F.col("vec").alias("other")), "id")
    return p.select("id", *[F.round(f(F.col("vec"), F.col("other")), 6).alias(n) for n, f in (("l2", distances.l2), ("ip", distances.ip), ("l1", distances.l1), ("linf", distances.linf))])


@query("f02_further_distances", f"WITH {V} SELECT q.id, round({S_METRICS['lp3']}, 6) AS lp, round({S_METRICS['braycurtis']}, 4) AS bray FROM v q JOIN v x ON x.id = q.id + 1 WHERE abs({s_fold('q.vec', 'x.vec', 'abs(p[1] + p[2])')}) > 0.1")
def _(spark, sf):
    v = vectors(spark, sf)
    p = v.join(v.select((F.col("id") - 1).alias("id"), F.col("vec").alias("other")), "id")
    some = distances.fold(F.col("vec"), F.col("other"), lambda a, b: F.abs(a + b)) > 0.1
    return p.where(some).select("id", F.round(distances.lp(3.0)(F.col("vec"), F.col("other")), 6).alias("lp"), F.round(distances.braycurtis(F.col("vec"), F.col("other")), 4).alias("bray"))


@query("f05_indexed_pairs", f"WITH {V} SELECT q.id AS qid, x.id, round({S_METRICS['l2']}, 6) AS dis FROM v q JOIN v x ON x.id = q.id // 2")
def _(spark, sf):
    v = vectors(spark, sf)
    return rounded(knn.knn_of_candidates(v.select(F.col("id").alias("qid"), F.floor(F.col("id") / 2).alias("id")), v, v))


@query("f11_transposed_bits", f"WITH {BIN} SELECT CAST(i AS INTEGER) AS place, sum(bits[i + 1]) AS ones FROM b, (SELECT unnest(range(64)) AS i) GROUP BY i")
def _(spark, sf):
    bits = codes32(vectors(spark, sf)).select(F.posexplode(binary.unpack(F.col("code"), 64)).alias("place", "bit"))
    return bits.groupBy("place").agg(F.sum("bit").cast("decimal(38,0)").alias("ones"))


@query("f14_rotation_is_orthonormal", "SELECT true AS orthonormal")
def _(spark, sf):
    r = transforms.random_rotation(64, 64)
    return spark.createDataFrame([(bool(np.abs(r @ r.T - np.eye(64)).max() < 1e-9),)], "orthonormal boolean")


# Evaluation and configuration.


@query("e03_neighbours_in_common", f"WITH {V}, p AS ({ALL_PAIRS}), f AS ({s_top('SELECT * FROM p', 10)}), g AS ({s_top('SELECT * FROM p WHERE id % 3 <> 0', 10)}) SELECT f.qid, count(g.id) AS common FROM f LEFT JOIN g ON f.qid = g.qid AND f.id = g.id GROUP BY f.qid")
def _(spark, sf):
    v = vectors(spark, sf)
    return evaluation.intersection(knn.exact_knn(few(v), v.where("id % 3 <> 0"), 10), knn.exact_knn(few(v), v, 10), 10)


@query("e06_results_equal_up_to_ties", "SELECT count(*) AS queries, count(*) AS equal FROM embeddings WHERE vec_id % 50 = 0")
def _(spark, sf):
    """Two ways to one result: rank by rank the rounded distances agree, whatever the ids."""
    v = vectors(spark, sf)
    a, b = (rounded(t, digits=4).select("qid", "rank", F.col("dis").alias(n)) for t, n in ((knn.exact_knn(few(v), v, 5), "a"), (knn.blocked_knn(few(v), v, 5), "b")))
    same = a.join(b, ["qid", "rank"]).groupBy("qid").agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("far"))
    return same.agg(F.count("*").alias("queries"), F.count_if(F.col("far") <= 2e-4).alias("equal"))


@query("e10_common_result_frequencies", f"WITH {V}, p AS ({ALL_PAIRS}), f AS ({s_top('SELECT * FROM p', 10)}), g AS ({s_top('SELECT * FROM p WHERE id % 3 <> 0', 10)}), n AS (SELECT f.qid, count(g.id) AS common FROM f LEFT JOIN g ON f.qid = g.qid AND f.id = g.id GROUP BY f.qid) SELECT common, count(*) AS queries FROM n GROUP BY common")
def _(spark, sf):
    v = vectors(spark, sf)
    n = evaluation.intersection(knn.exact_knn(few(v), v.where("id % 3 <> 0"), 10), knn.exact_knn(few(v), v, 10), 10)
    return n.groupBy("common").agg(F.count("*").alias("queries"))


TEXTS = ["Flat", "IVF16,Flat", "IVF64,PQ8x8", "IVF64,SQ8", "HNSW32", "PCA32,IVF100,Flat", "BFlat", "BIVF32", "BHash12"]


@query("x03_descriptions_round_trip", "SELECT unnest([" + ", ".join(f"'{t}'" for t in TEXTS) + "]) AS text, true AS same")
def _(spark, sf):
    return spark.createDataFrame([(t, factory.parse(64, t).describe() == t) for t in TEXTS], "text string, same boolean")


@query("e09_events_of_series", "SELECT CAST(user_id AS VARCHAR) AS series_id, count(*) AS points, count(*) FILTER (WHERE event_type = 'error') AS labelled FROM events GROUP BY user_id")
def _(spark, sf):
    return points(spark, sf).groupBy("series_id").agg(F.count("*").alias("points"), F.sum("label").cast("long").alias("labelled"))
