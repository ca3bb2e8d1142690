"""DuckDB SQL for the queries that SQL can express, by brute force over all pairs."""

from __future__ import annotations

K, LOW, HIGH, OPEN = 8, 100, 299, 9223372036854775807


def far(a: str, b: str, first: int = 1, past: int = 65) -> str:
    return f"list_sum(list_transform(range({first}, {past}), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i])))"


LABEL = "SELECT CAST(row_number() OVER (ORDER BY label, vec_id) - 1 AS BIGINT) AS pos, vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings"


def event(column: str) -> str:
    return f"SELECT CAST(row_number() OVER (ORDER BY {column}, vec_id) - 1 AS BIGINT) AS pos, vec_id AS id, {column} AS k, CAST(embedding AS DOUBLE[]) AS e FROM embeddings JOIN events ON vec_id = event_id"


def pairs(vectors: str = LABEL, where: str = "true", also: str = "", dist: str = "") -> str:
    """Common tables v and p (node, nbr, dist) of all pairs."""
    return f"WITH RECURSIVE v AS MATERIALIZED ({vectors}), {also} p AS MATERIALIZED (SELECT a.pos AS node, b.pos AS nbr, {dist or far('a.e', 'b.e')} AS dist FROM v a, v b WHERE a.pos <> b.pos AND {where})"


def graph(k: int, where: str = "true", vectors: str = LABEL, also: str = "", name: str = "g", dist: str = "") -> str:
    return pairs(vectors, where, also, dist) + f", {name} AS MATERIALIZED (SELECT * FROM (SELECT node, nbr, dist, CAST(row_number() OVER (PARTITION BY node ORDER BY dist, nbr) AS INT) AS rank FROM p) WHERE rank <= {k})"


EDGES = " SELECT node, nbr, rank, round(dist, 6) AS dist FROM g"
IN_RANGE = f"a.pos BETWEEN {LOW} AND {HIGH} AND b.pos BETWEEN {LOW} AND {HIGH}"
RANGE_GRAPH = graph(K, IN_RANGE) + EDGES


def query(pos: int, k: int, where: str = "true", vectors: str = LABEL) -> str:
    return f"WITH v AS MATERIALIZED ({vectors}) SELECT b.pos, CAST(row_number() OVER (ORDER BY {far('a.e', 'b.e')}, b.pos) AS INT) AS rank, round({far('a.e', 'b.e')}, 6) AS dist FROM v a, v b WHERE a.pos = {pos} AND {where} QUALIFY rank <= {k}"


def index(vectors: str = LABEL) -> str:
    """Common table ix: the index by each point's list of nearer ones."""
    return (
        pairs(vectors)
        + f""", s AS (SELECT *, CASE WHEN nbr < node THEN 'L' ELSE 'R' END AS side FROM p),
        n AS (SELECT *, list(nbr) OVER (PARTITION BY node, side ORDER BY dist, nbr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nearer FROM s),
        b AS (SELECT *, CASE side WHEN 'L' THEN coalesce(list_sort(nearer, 'DESC')[{K}], -1) ELSE coalesce(list_sort(nearer, 'ASC')[{K}], {OPEN}) END AS sub FROM n),
        ix AS MATERIALIZED (SELECT node, side, nbr, dist, CAST(sub AS BIGINT) AS sub FROM b WHERE (side = 'L' AND sub < nbr) OR (side = 'R' AND nbr < sub))"""
    )


NEXT = "FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings) JOIN (SELECT vec_id - 1 AS vec_id, CAST(embedding AS DOUBLE[]) AS y FROM embeddings) USING (vec_id)"
DOT = "list_sum(list_transform(range(1, 65), lambda i: x[i] * {0}[i]))"
SPAN = "BETWEEN (SELECT count(*) // 5 FROM embeddings) AND (SELECT 3 * count(*) // 5 - 1 FROM embeddings)"
POST = (
    graph(2 * K, name="w")
    + f""", t AS MATERIALIZED (SELECT * FROM (SELECT node, nbr, dist, row_number() OVER (PARTITION BY node ORDER BY dist, nbr) AS rank FROM p
      WHERE node {SPAN} AND nbr {SPAN}) WHERE rank <= {K}),
    f AS MATERIALIZED (SELECT * FROM (SELECT node, nbr, dist, row_number() OVER (PARTITION BY node ORDER BY dist, nbr) AS rank FROM w
      WHERE node {SPAN} AND nbr {SPAN}) WHERE rank <= {K})"""
)
CHANGED = f"SELECT pos, id, CASE WHEN id % 50 = 0 THEN list_reverse(e) ELSE e END AS e FROM ({LABEL}) WHERE id % 70 <> 0"
BETWEEN = "(list_sum(list_transform(range(1, 65), lambda i: {0}[i] * {1}[i])))"
IP = f"1 - {BETWEEN.format('a.e', 'b.e')}"
COSINE = f"1 - {BETWEEN.format('a.e', 'b.e')} / sqrt({BETWEEN.format('a.e', 'a.e')} * {BETWEEN.format('b.e', 'b.e')})"
INDEX = " SELECT node, side, nbr, sub, round(dist, 6) AS dist FROM ix"
MULTI = (
    pairs()
    + f""", q(qid, l, r) AS (VALUES (0, 0, 49), (1, 100, 299), (2, 250, 250), (3, 400, 499), (4, 37, 412))
        SELECT qid, node, nbr, CAST(row_number() OVER (PARTITION BY qid, node ORDER BY dist, nbr) AS INT) AS rank, round(dist, 6) AS dist FROM p, q WHERE node BETWEEN l AND r AND nbr BETWEEN l AND r QUALIFY rank <= {K}"""
)
#: An edge goes if two edges kept before it (by rank, then node) lead the same way; settled round by round.
DETOURS = (
    graph(K)
    + """, ways AS MATERIALIZED (
      SELECT c.node, a.nbr AS mid, c.nbr FROM g c JOIN g a ON a.node = c.node AND a.rank < c.rank JOIN g b ON b.node = a.nbr AND b.nbr = c.nbr AND (b.rank < c.rank OR (b.rank = c.rank AND b.node < c.node))),
    s AS (
      SELECT 0 AS round, g.node, g.nbr, g.rank, g.dist, CASE WHEN EXISTS (SELECT 1 FROM ways w WHERE w.node = g.node AND w.nbr = g.nbr) THEN NULL ELSE true END AS kept FROM g
      UNION ALL
      SELECT s.round + 1, s.node, s.nbr, s.rank, s.dist, coalesce(s.kept, v.now) FROM s LEFT JOIN (
        SELECT w.node, w.nbr, CASE WHEN max((x.kept AND y.kept)::INT) = 1 THEN false WHEN count(*) FILTER (WHERE coalesce(x.kept, true) AND coalesce(y.kept, true)) = 0 THEN true END AS now
        FROM ways w JOIN s x ON x.node = w.node AND x.nbr = w.mid JOIN s y ON y.node = w.mid AND y.nbr = w.nbr GROUP BY w.node, w.nbr) v ON v.node = s.node AND v.nbr = s.nbr
      WHERE (SELECT count(*) FROM s WHERE kept IS NULL) > 0)
    SELECT node, nbr, rank, round(dist, 6) AS dist FROM s WHERE kept AND round = (SELECT max(round) FROM s)"""
)
#: A fold over each node's candidates, nearest first: one is kept if no kept one is nearer to it than the node is.
DIVERSE = (
    graph(3 * K)
    + f""", blocked AS MATERIALIZED (SELECT c.node, c.rank, list(o.nbr) AS others FROM g c JOIN g o ON o.node = c.node AND o.rank < c.rank JOIN p ON p.node = c.nbr AND p.nbr = o.nbr AND p.dist < c.dist GROUP BY c.node, c.rank),
    s AS (
      SELECT DISTINCT node, 0 AS rank, CAST([] AS BIGINT[]) AS kept FROM g
      UNION ALL
      SELECT s.node, s.rank + 1, CASE WHEN len(s.kept) < {K} AND len(list_intersect(s.kept, coalesce(b.others, []))) = 0 THEN list_append(s.kept, c.nbr) ELSE s.kept END
      FROM s JOIN g c ON c.node = s.node AND c.rank = s.rank + 1 LEFT JOIN blocked b ON b.node = s.node AND b.rank = s.rank + 1),
    e AS (SELECT s.node, s.kept FROM s JOIN (SELECT node, max(rank) AS rank FROM g GROUP BY node) m ON m.node = s.node AND m.rank = s.rank),
    r AS (SELECT g.node, g.nbr, g.dist, CAST(row_number() OVER (PARTITION BY g.node ORDER BY CASE WHEN list_contains(e.kept, g.nbr) THEN 0 ELSE 1 END, g.rank) AS INT) AS rank FROM g JOIN e ON e.node = g.node)
    SELECT node, nbr, rank, round(dist, 6) AS dist FROM r WHERE rank <= {K}"""
)


def reached(n_true: str) -> str:
    """The row of a search that finds its share of what SQL counts."""
    return f"SELECT ({n_true})::BIGINT AS n_true, true AS reached"


def seen(vector: str = "embedding", where: str = "true", key: str = "vec_id AS pos, ") -> str:
    """What a reader of vectors gives."""
    x = f"CAST({vector} AS DOUBLE[])"
    return f"SELECT {key}64::BIGINT AS n, round({x}[1], 4) AS first, round({x}[64], 4) AS last, round(list_sum({x}), 4) AS total FROM embeddings WHERE {where}"


ORACLES = {
    "exact_knn_graph": graph(K) + EDGES,
    "range_knn_graph": RANGE_GRAPH,
    "range_graph_from_index": RANGE_GRAPH,
    "raw_delta_range_graph": RANGE_GRAPH,
    "range_knn_query": query(250, 10, f"b.pos BETWEEN {LOW} AND {HIGH}"),
    "radius_knn": query(250, 50, f"{far('a.e', 'b.e')} <= 1.7"),
    "interval_index": index() + " SELECT node, side, nbr, sub, round(dist, 6) AS dist FROM ix",
    "index_node_lookup": index() + f" SELECT side, nbr, sub, round(dist, 6) AS dist FROM ix WHERE node = 150 AND ((side = 'L' AND sub < {LOW} AND nbr >= {LOW}) OR (side = 'R' AND nbr <= {HIGH} AND sub > {HIGH}))",
    "partial_windows": pairs()
    + f""", c AS (SELECT a.node, a.nbr AS bound, b.nbr, b.dist FROM p a JOIN p b ON a.node = b.node WHERE (a.nbr < a.node AND b.nbr >= a.nbr AND b.nbr < a.node) OR (a.nbr > a.node AND b.nbr <= a.nbr AND b.nbr > a.node)),
        r AS (SELECT *, row_number() OVER (PARTITION BY node, bound ORDER BY dist, nbr) AS rank FROM c),
        t AS (SELECT node, bound, string_agg(nbr, ',' ORDER BY rank) AS pts, max((nbr = bound)::INT) AS changes FROM r WHERE rank <= {K} GROUP BY node, bound)
        SELECT node, CASE WHEN bound < node THEN 'L' ELSE 'R' END AS side, bound, pts FROM t WHERE changes = 1""",
    "cal_rectangle_lookup": graph(4, IN_RANGE) + " SELECT node, string_agg(nbr, ',' ORDER BY nbr) AS pts FROM g GROUP BY node HAVING count(*) = 4",
    "multi_range_graph": MULTI,
    "saved_index_range_graph": RANGE_GRAPH,
    "saved_index_multi_range": MULTI,
    "sql_range_graph": RANGE_GRAPH,
    "inner_product_range_graph": graph(K, IN_RANGE, dist=IP) + EDGES,
    "cosine_range_graph": graph(K, IN_RANGE, dist=COSINE) + EDGES,
    "next_neighbours": query(250, 30, f"b.pos BETWEEN {LOW} AND {HIGH}") + " AND rank > 20",
    "l2_distance": f"SELECT vec_id, round({far('x', 'y')}, 6) AS l2sqr, round(sqrt({far('x', 'y')}), 6) AS l2, round({far('x', 'y')}, 6) AS unrolled {NEXT}",
    "inner_product_distance": f"SELECT vec_id, round(1 - {DOT.format('y')}, 6) AS ip, round({DOT.format('x')}, 6) AS norm2 {NEXT}",
    "subrange_distance": f"SELECT vec_id, round({far('x', 'y', 9, 25)}, 6) AS part {NEXT}",
    "l2_normalize": "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), n AS (SELECT vec_id, x, sqrt(" + DOT.format("x") + ") AS n FROM v) SELECT vec_id, CAST(k AS INT) AS k, round(x[k + 1] / n, 6) AS x FROM n, range(64) r(k)",
    "integer_distance": "SELECT vec_id, CAST(list_sum(list_transform(range(1, 65), lambda i: (floor(x[i] * 100) - floor(y[i] * 100)) * (floor(x[i] * 100) - floor(y[i] * 100)))) AS BIGINT) AS d FROM (SELECT vec_id, embedding AS x FROM embeddings) JOIN (SELECT vec_id - 1 AS vec_id, embedding AS y FROM embeddings) USING (vec_id)",
    "argsort_array": "WITH v AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS k FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x, k) AS rank FROM v) SELECT vec_id, string_agg(k, ',' ORDER BY rank) AS positions FROM r GROUP BY vec_id",
    "post_filter_knn": f"WITH v AS MATERIALIZED ({LABEL}), n AS (SELECT b.pos, {far('a.e', 'b.e')} AS d FROM v a, v b WHERE a.pos = 250 ORDER BY d, b.pos LIMIT 100) SELECT pos, CAST(row_number() OVER (ORDER BY d, pos) AS INT) AS rank, round(d, 6) AS dist FROM n WHERE pos BETWEEN {LOW} AND {HIGH} QUALIFY rank <= 10",
    "pre_filter_knn": f"WITH v AS MATERIALIZED ({LABEL}) SELECT a.pos AS q, b.pos, CAST(row_number() OVER (PARTITION BY a.pos ORDER BY {far('a.e', 'b.e')}, b.pos) AS INT) AS rank, round({far('a.e', 'b.e')}, 6) AS dist FROM v a, v b WHERE a.pos IN (110, 250, 290) AND b.pos BETWEEN {LOW} AND {HIGH} QUALIFY rank <= 5",
    "knng_recall": POST + ", h AS (SELECT count(*) AS h FROM t JOIN f USING (node, nbr)) SELECT CAST(h AS BIGINT) AS hits, round(h / (SELECT count(*) FROM t), 9) AS recall, round(h / (SELECT count(*) FROM f), 9) AS precision FROM h",
    "approximation_ratio": POST + ", m AS (SELECT node, max(dist) AS far, count(*) AS n FROM f GROUP BY node) SELECT t.node AS qid, round(CASE WHEN max(m.far) IS NULL THEN 0 WHEN max(t.dist) = 0 THEN -1 ELSE max(m.far) / max(t.dist) END, 6) AS ratio FROM t LEFT JOIN m USING (node) WHERE m.n IS NULL OR t.rank <= m.n GROUP BY t.node",
    "knng_accuracy": POST + ", n AS (SELECT t.node, coalesce(avg(CASE WHEN t.dist > 0 THEN abs(f.dist - t.dist) / t.dist END), 0) AS error, max(CASE WHEN t.rank = 1 THEN (t.dist = f.dist)::INT END) AS one FROM t JOIN f ON t.node = f.node AND t.rank = f.rank GROUP BY t.node) SELECT round(avg(error), 6) AS error, round(avg(one), 6) AS one_recall FROM n",
    "merge_recall": POST
    + """, a AS (SELECT node, round(dist, 2) AS d, row_number() OVER (PARTITION BY node, round(dist, 2) ORDER BY nbr) AS k FROM t), b AS (SELECT node, round(dist, 2) AS d, row_number() OVER (PARTITION BY node, round(dist, 2) ORDER BY nbr) AS k FROM f),
        top AS (SELECT node, max(d) AS far, count(*) AS n FROM a GROUP BY node)
        SELECT top.node, round((SELECT count(*) FROM a JOIN b USING (node, d, k) WHERE node = top.node) / n, 9) AS recall,
          (SELECT count(*) FROM b WHERE b.node = top.node AND b.d < far AND NOT EXISTS (SELECT 1 FROM a WHERE a.node = b.node AND a.d = b.d))::BIGINT AS unstable FROM top""",
    "count_precision": POST + " SELECT t.node, round(count(f.nbr) / count(*), 9) AS precision FROM t LEFT JOIN f ON f.node = t.node AND f.nbr = t.nbr GROUP BY t.node",
    "graph_delta": graph(2 * K) + f", n AS (SELECT node, count(*) FILTER (WHERE nbr % 2 = 0) / {K} AS d FROM g WHERE rank <= {K} GROUP BY node) SELECT round(avg(d), 9) AS delta FROM n",
    "reverse_graph": graph(K) + ", u AS (SELECT node, nbr, dist FROM g UNION SELECT nbr, node, dist FROM g) SELECT node, nbr, CAST(row_number() OVER (PARTITION BY node ORDER BY dist, nbr) AS INT) AS rank, round(dist, 6) AS dist FROM (SELECT node, nbr, min(dist) AS dist FROM u GROUP BY node, nbr)",
    "prune_level1": graph(3) + EDGES,
    "two_hop_candidates": graph(K) + " SELECT DISTINCT a.node, b.nbr FROM g a JOIN g b ON a.nbr = b.node WHERE a.node <> b.nbr AND NOT EXISTS (SELECT 1 FROM g c WHERE c.node = a.node AND c.nbr = b.nbr)",
    "rerank_graph": graph(4) + ", h AS (SELECT DISTINCT a.node, b.nbr FROM g a JOIN g b ON a.nbr = b.node WHERE a.node <> b.nbr AND NOT EXISTS (SELECT 1 FROM g c WHERE c.node = a.node AND c.nbr = b.nbr)) SELECT node, nbr, CAST(row_number() OVER (PARTITION BY node ORDER BY dist, nbr) AS INT) AS rank, round(dist, 6) AS dist FROM h JOIN p USING (node, nbr) QUALIFY rank <= 5",
    "upsert_delete_knn": f"WITH o AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), k AS (SELECT id, CASE label WHEN 3 THEN list_reverse(e) ELSE e END AS e FROM o WHERE label <> 5) SELECT CAST(k.id AS BIGINT) AS pos, CAST(row_number() OVER (ORDER BY {far('k.e', 'q.e')}, k.id) AS INT) AS rank, round({far('k.e', 'q.e')}, 6) AS dist FROM k, (SELECT e FROM o WHERE id = 3) q QUALIFY rank <= 10",
    "index_size_stats": index() + " SELECT count(*) AS n_rows, count(DISTINCT node) AS n_nodes, round(count(*) / count(DISTINCT node), 6) AS rows_per_node, count(*) * 33 AS n_bytes FROM ix",
    "index_integrity": index() + " SELECT count(*) AS n_rows, " + ", ".join(f"0::BIGINT AS {c}" for c in ("wrong_side", "wrong_bound", "own", "repeated", "crowded")) + " FROM ix",
    "index_profile": index()
    + f", per AS (SELECT side, node, count(*) AS c, count(*) FILTER (WHERE sub IN (-1, {OPEN})) AS o FROM ix GROUP BY side, node) SELECT side, sum(c)::BIGINT AS n_rows, count(*) AS n_nodes, sum(o)::BIGINT AS n_open, min(c) AS fewest, round(avg(c), 6) AS mean, max(c) AS most FROM per GROUP BY side",
    "append_maintenance": index() + INDEX,
    "stream_append_index": index() + INDEX,
    "index_repair": index(CHANGED) + INDEX,
    "prune_level2": DETOURS,
    "diverse_neighbours": DIVERSE,
    "nn_descent_recall": reached(f"SELECT {K} * count(*) FROM embeddings"),
    "lsh_knn_recall": reached(f"SELECT {K} * count(*) FROM embeddings"),
    "beam_search_recall": reached("SELECT 10"),
    "approximate_index_recall": reached(f"SELECT {K} * (200 + (3 * count(*) // 5 - count(*) // 5) + count(*)) FROM embeddings"),
    "graph_search_recall": reached("SELECT 10"),
    "layered_search_recall": reached("SELECT 10"),
    "quantized_search_recall": reached("SELECT 10"),
    "fvecs_file": seen(),
    "raw_file": seen(),
    "bvecs_file": seen("list_transform(embedding, lambda x: floor(abs(x::DOUBLE) * 100))"),
    "headed_matrix_file": seen(),
    "first_rows_file": seen(where="vec_id < 300"),
    "dense_text_file": seen(key=""),
    "word_text_file": seen(),
    "tsv_file": seen(),
    "keyed_csv_file": seen(key="vec_id AS pos, vec_id * 3 AS search_key, "),
    "truth_file": graph(K, IN_RANGE) + " SELECT node, nbr, rank FROM g",
    "truth_query_file": graph(5, f"a.pos IN (110, 250, 290) AND b.pos BETWEEN {LOW} AND {HIGH}").replace("a.pos <> b.pos AND", "") + f" SELECT node AS qid, {LOW}::BIGINT AS l, {HIGH}::BIGINT AS r, string_agg(nbr, ',' ORDER BY rank) AS nbrs FROM g GROUP BY node",
    "graph_file": graph(K) + EDGES,
    "graph_file_without_distances": graph(K) + " SELECT node, nbr, rank FROM g",
    "graph_text": graph(K) + " SELECT node || ' ' || string_agg(nbr, ' ' ORDER BY rank) AS line FROM g GROUP BY node",
    "vector_store_file": seen("CASE WHEN vec_id % 10 = 0 THEN list_reverse(embedding) ELSE embedding END"),
    "result_rows_file": graph(5, f"a.pos IN (110, 250) AND b.pos BETWEEN {LOW} AND {HIGH}").replace("a.pos <> b.pos AND", "") + " SELECT nbr AS pos, rank, round(dist, 6) AS dist, node::INT AS q FROM g",
    "index_experiment": index() + f" SELECT 'exact' AS method, (SELECT count(*) FROM embeddings) AS n, (SELECT count(*) FROM embeddings) AS k1, {K} AS k2, count(DISTINCT node) AS nodes, count(*) AS windows, 33 * count(*) AS bytes FROM ix",
    "range_experiment": f"SELECT unnest(['index', 'index without bounds']) AS method, (SELECT count(*) FROM embeddings) AS n, {K} AS k, {LOW}::BIGINT AS l, {HIGH}::BIGINT AS r, 1.0::DOUBLE AS recall, 1.0::DOUBLE AS precision",
    "split_keeping_empty": "SELECT event_id, len(regexp_split_to_array(props, '[,:]'))::BIGINT AS n, regexp_split_to_array(props, '[,:]')[-1] AS last FROM events",
    "base100_ids": "SELECT event_id, list_sum(list_transform(range(4), lambda i: (ascii(substr(rpad(event_type, 4, '_'), (i + 1)::INT, 1)) - 38) * power(100, 3 - i)::BIGINT))::BIGINT AS code FROM events",
    "distinct_sample": "SELECT label, least(20, count(*)) AS n, least(20, count(*)) AS n_again FROM embeddings GROUP BY label",
    "synthetic_vectors": "SELECT sum(len(embedding))::BIGINT AS n_numbers, true AS centred, true AS spread, sum(len(embedding))::BIGINT AS n_drawn FROM embeddings",
    "dyadic_multi_range": pairs()
    + f""", n AS (SELECT count(*) AS n FROM v), q AS (SELECT pos AS qid, least(pos, (pos * 7919 + 13) % n) AS l, greatest(pos, (pos * 7919 + 13) % n) AS r FROM v, n),
        w AS (SELECT qid, node, nbr, dist, row_number() OVER (PARTITION BY qid, node ORDER BY dist, nbr) AS rank FROM p JOIN q ON node BETWEEN l AND r AND nbr BETWEEN l AND r QUALIFY rank <= {K})
        SELECT qid, count(*) AS n_edges, sum(node * 31 + nbr * 17 + rank)::BIGINT AS checksum, round(sum(dist), 4) AS dist FROM w GROUP BY qid""",
    "many_graph_search_recall": reached("SELECT 10 * count(*) FROM embeddings"),
    "many_beam_search_recall": reached("SELECT 10 * count(*) FROM embeddings"),
    "many_layered_search_recall": reached("SELECT 10 * count(*) FROM embeddings"),
    "layered_deleted_recall": reached("SELECT 10 * count(*) FROM embeddings") + ", 0::BIGINT AS n_dead",
    "layered_insert_recall": reached("SELECT 10 * count(*) FROM embeddings"),
    "layered_repair_recall": reached("SELECT 10 * (count(*) - (count(*) + 29) // 30) FROM embeddings"),
    "graph_binary_file": graph(K) + " SELECT node, nbr, rank, round(dist::FLOAT::DOUBLE, 3) AS dist FROM g",
    "graph_bare_file": graph(K) + " SELECT node, nbr, rank, true AS bare FROM g",
    "layered_file": seen(),
    "index_text_file": index() + " SELECT node, side, nbr, sub FROM ix",
    "time_key_range_graph": graph(K, "a.k BETWEEN (SELECT k FROM v WHERE pos = 100) AND (SELECT k FROM v WHERE pos = 299) AND b.k BETWEEN (SELECT k FROM v WHERE pos = 100) AND (SELECT k FROM v WHERE pos = 299)", event("ts")) + EDGES,
    "value_key_range_graph": graph(K, IN_RANGE, event("value")) + EDGES,
}
