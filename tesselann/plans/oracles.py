"""DuckDB SQL for the registered queries. Every statement is a list of common table expressions and a last SELECT."""

from __future__ import annotations

from ..functions.hashing import C1, C2, C3, F1, F2

MASK = 4294967295
DIMS, HIDDEN, BUCKETS, HASHED, R, K, TOPM, MF, TOP = 64, 16, 32, 8, 4, 2, 2, 2, 10


def murmur(rows: str, keep: str) -> str:
    """``keep`` and h, the unsigned MurmurHash3 of x under seed, for ``rows`` that have these; a step a level."""
    out = f"SELECT {keep}, seed, (x * {C1}) & {MASK} AS k FROM ({rows})"
    out = f"SELECT {keep}, seed, ((k << 15) | (k >> 17)) & {MASK} AS k FROM ({out})"
    out = f"SELECT {keep}, xor(seed, (k * {C2}) & {MASK}) AS h FROM ({out})"
    for step in (f"((h << 13) | (h >> 19)) & {MASK}", f"xor((h * 5 + {C3}) & {MASK}, 4)", f"(xor(h, h >> 16) * {F1}) & {MASK}", f"(xor(h, h >> 13) * {F2}) & {MASK}", "xor(h, h >> 16)"):
        out = f"SELECT {keep}, {step} AS h FROM ({out})"
    return out


V = "v AS MATERIALIZED (SELECT vec_id AS item, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)"
SCALED = "v AS MATERIALIZED (SELECT vec_id AS item, CAST(list_transform(embedding, lambda x: CAST(CAST(x AS DOUBLE) * (1 + vec_id % 5) AS FLOAT)) AS DOUBLE[]) AS vec FROM embeddings)"
Q = "q AS MATERIALIZED (SELECT item AS qid, vec AS qvec FROM v WHERE item % 20 = 0)"
REPS = f"reps AS (SELECT range AS r FROM range({R}))"
HASH = f"asg AS MATERIALIZED (SELECT r, item, CAST(h % {HASHED} AS BIGINT) AS bucket FROM ({murmur('SELECT r, item, CAST(item AS HUGEINT) AS x, CAST(r AS HUGEINT) AS seed FROM v, reps', 'r, item')}))"
NORM = "sqrt(list_inner_product(vec, vec))"
SCORES = {
    "ip": "list_inner_product(qvec, vec)",
    "l2": "2 * list_inner_product(qvec, vec) - list_inner_product(vec, vec)",
    "l2_plain": f"2 * list_inner_product(qvec, vec) - {NORM}",
    "cosine": f"list_inner_product(qvec, vec) / (sqrt(list_inner_product(qvec, qvec)) * {NORM})",
}


def formula(name: str, cols: str, tables: str, place: str, seed: int, scale: str) -> str:
    rows = f"SELECT r, {cols}, CAST({place} AS HUGEINT) AS x, CAST({seed} + r AS HUGEINT) AS seed FROM reps, {tables}"
    return f"{name} AS MATERIALIZED (SELECT r, {cols}, (CAST(h % 17 AS DOUBLE) - 8) / {scale} AS w FROM ({murmur(rows, f'r, {cols}')}))"


I_, J_, B_ = f"(SELECT range AS i FROM range({DIMS}))", f"(SELECT range AS j FROM range({HIDDEN}))", f"(SELECT range AS b FROM range({BUCKETS}))"
MODEL = ", ".join([
    formula("w1", "i, j", f"{I_}, {J_}", f"i * {HIDDEN} + j", 1000, "8"),
    formula("b1", "j", J_, "j", 3000, "512"),
    formula("w2", "j, b", f"{J_}, {B_}", f"j * {BUCKETS} + b", 2000, "8"),
    formula("b2", "b", B_, "b", 4000, "512"),
    f"vx AS MATERIALIZED (SELECT item, i, vec[i + 1] AS x FROM v, {I_})",
    "hid AS MATERIALIZED (SELECT s.r, s.item, s.j, greatest(s.z + b1.w, 0) AS h FROM (SELECT r, item, j, sum(x * w) AS z FROM vx JOIN w1 USING (i) GROUP BY ALL) s JOIN b1 ON s.r = b1.r AND s.j = b1.j)",
    "logit AS MATERIALIZED (SELECT s.r, s.item, s.b, s.z + b2.w AS z FROM (SELECT hid.r, item, b, sum(h * w) AS z FROM hid JOIN w2 ON hid.r = w2.r AND hid.j = w2.j GROUP BY ALL) s JOIN b2 ON s.r = b2.r AND s.b = b2.b)",
    "best AS MATERIALIZED (SELECT r, item, row_number() OVER (PARTITION BY r, item ORDER BY z DESC, b) - 1 AS k, b AS bucket FROM logit)",
])
#: Items pass in order of id; the state has the loads of all buckets.
LEAST = ", ".join([
    f"pref AS MATERIALIZED (SELECT r, item, row_number() OVER (PARTITION BY r ORDER BY item) AS n, list(bucket ORDER BY k) AS p FROM best WHERE k < {K} GROUP BY r, item)",
    f"steps AS (SELECT r, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS item, CAST(NULL AS BIGINT) AS bucket, list_transform(range({BUCKETS}), lambda x: CAST(0 AS BIGINT)) AS loads FROM reps UNION ALL SELECT r, n, item, bucket, list_transform(loads, lambda x, i: CASE WHEN i = bucket + 1 THEN x + 1 ELSE x END) FROM (SELECT s.r, pref.n, pref.item, CASE WHEN s.loads[pref.p[2] + 1] < s.loads[pref.p[1] + 1] THEN pref.p[2] ELSE pref.p[1] END AS bucket, s.loads FROM steps s JOIN pref ON pref.r = s.r AND pref.n = s.n + 1))",
    "asg AS MATERIALIZED (SELECT r, item, bucket FROM steps WHERE n > 0)",
])
#: Probes of a query that is an item: its own bucket, or its best buckets.
PROBE_OWN = "probe AS MATERIALIZED (SELECT qid, r, CAST(0 AS BIGINT) AS k, bucket FROM asg JOIN q ON item = qid)"
PROBE_BEST = f"probe AS MATERIALIZED (SELECT qid, r, k, bucket FROM best JOIN q ON item = qid WHERE k < {TOPM})"
HITS = "hit AS MATERIALIZED (SELECT qid, p.r, p.k, a.item FROM probe p JOIN asg a ON p.r = a.r AND p.bucket = a.bucket)"
COUNT = "cnt AS MATERIALIZED (SELECT qid, item, count(*) AS hits, max(r) AS last FROM hit GROUP BY qid, item)"
CAND = f"cand AS (SELECT qid, item FROM cnt WHERE hits >= {MF})"
HIST = f"hist AS (SELECT g.r, g.bucket, coalesce(n, 0) AS n FROM (SELECT r, range AS bucket FROM reps, range({HASHED})) g LEFT JOIN (SELECT r, bucket, count(*) AS n FROM asg GROUP BY ALL) h ON g.r = h.r AND g.bucket = h.bucket)"


def ranked(rows: str, score: str, k: int = TOP) -> str:
    return f"SELECT qid, rk, item FROM (SELECT qid, item, row_number() OVER (PARTITION BY qid ORDER BY {score} DESC, item) AS rk FROM {rows}) WHERE rk <= {k}"


def sql(last: str, *parts: str) -> str:
    return f"WITH RECURSIVE {', '.join(parts)} {last}"


RERANK = "cand JOIN v USING (item) JOIN q USING (qid)"
TRUTH = f"truth AS MATERIALIZED ({ranked('v, q', SCORES['cosine'])})"
FOUND = f"found AS MATERIALIZED ({ranked(RERANK, SCORES['cosine'])})"
HASH_SIDE = (V, Q, REPS, HASH, PROBE_OWN, HITS, COUNT, CAND)
MODEL_SIDE = (V, Q, REPS, MODEL, LEAST, PROBE_BEST, HITS, COUNT, CAND)
SAMPLE = f"pick AS (SELECT item FROM (SELECT item, CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS h FROM ({murmur('SELECT item, CAST(item AS HUGEINT) AS x, CAST(0 AS HUGEINT) AS seed FROM v', 'item')})) ORDER BY h, item LIMIT 100)"

ORACLES = {
    "vector_norms": sql(f"SELECT item AS vec_id, round({NORM}, 6) AS norm FROM v", SCALED),
    "vector_normalize": sql(f"SELECT item AS vec_id, CAST(i AS BIGINT) AS pos, round(vec[i + 1] / {NORM}, 6) AS x FROM v, {I_}", SCALED),
    "sample_rows": sql("SELECT row_number() OVER (ORDER BY item) - 1 AS train_id, item AS vec_id FROM pick", V, SAMPLE),
    **{f"knn_{m}": sql(ranked("v, q", SCORES[m]), SCALED, Q) for m in ("ip", "l2", "cosine")},
    "hash_partition": sql("SELECT r, item, bucket FROM asg", V, REPS, HASH),
    "bucket_histogram": sql("SELECT r, bucket, n FROM hist", V, REPS, HASH, HIST),
    "bucket_offsets": sql("SELECT r, bucket, CAST(stop - n AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM (SELECT *, sum(n) OVER (PARTITION BY r ORDER BY bucket) AS stop FROM hist)", V, REPS, HASH, HIST),
    "postings": sql("SELECT r, bucket, row_number() OVER (PARTITION BY r, bucket ORDER BY item) - 1 AS pos, item FROM asg", V, REPS, HASH),
    "load_balance": sql("SELECT r, max(n) AS max_load, min(n) AS min_load, count(*) FILTER (n > 0) AS non_empty FROM hist GROUP BY r", V, REPS, HASH, HIST),
    "label_multi_hot": sql("SELECT DISTINCT r, qid AS train_id, bucket FROM truth JOIN asg USING (item)", V, Q, REPS, HASH, TRUTH),
    "mlp_top_buckets_sorted": sql(f"SELECT r, item, k, bucket FROM best WHERE k < {K}", V, REPS, MODEL),
    "least_loaded_assign": sql("SELECT r, item, bucket FROM asg", V, REPS, MODEL, LEAST),
    "probe_postings": sql("SELECT qid, r, k, item FROM hit", *HASH_SIDE),
    "candidates_mf1": sql("SELECT qid, item FROM cnt WHERE last > 0", *HASH_SIDE),
    "candidates_mf1_all": sql("SELECT qid, item FROM cnt", *HASH_SIDE),
    "candidates_mf2": sql("SELECT qid, item FROM cnt WHERE hits >= 2", *HASH_SIDE),
    "candidates_mf3": sql("SELECT qid, item FROM cnt WHERE hits >= 3", *HASH_SIDE),
    "candidates_single_rep": sql("SELECT DISTINCT qid, item FROM hit WHERE r = 0", *HASH_SIDE),
    "candidates_capped": sql(f"SELECT qid, pos, item FROM (SELECT qid, item, row_number() OVER (PARTITION BY qid ORDER BY r, k, item) - 1 AS pos FROM (SELECT *, row_number() OVER (PARTITION BY qid, item ORDER BY r, k) AS n FROM hit) WHERE n = {MF}) WHERE pos < 20", *MODEL_SIDE),
    "candidates_adaptive": sql("SELECT qid, threshold, item FROM cnt JOIN (SELECT qid, coalesce(max(t), 1) AS threshold FROM (SELECT qid FROM q) LEFT JOIN (SELECT qid, t FROM cnt, (SELECT range AS t FROM range(1, 4)) WHERE hits >= t GROUP BY ALL HAVING count(*) >= 10) USING (qid) GROUP BY qid) USING (qid) WHERE hits >= threshold", *HASH_SIDE),
    **{f"rerank_{m}": sql(ranked(RERANK, SCORES[m]), SCALED, *HASH_SIDE[1:]) for m in ("ip", "l2", "cosine")},
    "rerank_l2_compat": sql(ranked(RERANK, SCORES["l2_plain"]), SCALED, *HASH_SIDE[1:]),
    "search_end_to_end": sql("SELECT * FROM found", *MODEL_SIDE, FOUND),
    "recall_at_10": sql("SELECT (SELECT count(*) FROM found JOIN truth USING (qid, item)) AS n_hits, (SELECT count(*) FROM q) AS n_queries", *MODEL_SIDE, TRUTH, FOUND),
    "candidate_recall": sql("SELECT (SELECT count(*) FROM cand JOIN truth USING (qid, item)) AS n_hits, (SELECT count(*) FROM q) AS n_queries", *MODEL_SIDE, TRUTH),
    "avg_candidate_size": sql("SELECT (SELECT count(*) FROM cand) AS total, (SELECT count(*) FROM q) AS n_queries", *MODEL_SIDE),
    "result_array_padded": sql("SELECT qid, g.pos, coalesce(item, -1) AS item FROM (SELECT qid, range AS pos FROM q, range(10)) g LEFT JOIN (SELECT qid, rk - 1 AS pos, item FROM found) f USING (qid, pos)", *HASH_SIDE[:-1], "cand AS (SELECT qid, item FROM cnt WHERE hits >= 4)", FOUND),
    "index_roundtrip": sql("SELECT r, bucket, count(*) AS n FROM asg GROUP BY ALL", V, REPS, MODEL, LEAST),
}
