"""DuckDB SQL for the queries in ``queries``, written from their definitions."""

from __future__ import annotations

from loomgraph.operators.telemetry import SUFFIX
from loomgraph.plans.derived import opcode_names

PAIRS = "pairs AS (SELECT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber)"
SIMPLE = PAIRS + ", simple AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM pairs WHERE src <> dst)"
#: Edges from the end of lower (degree, id) up, made once, and pairs of them that begin at one vertex.
RISING = PAIRS + """, simple AS MATERIALIZED (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM pairs WHERE src <> dst),
degrees AS MATERIALIZED (SELECT v, count(*) AS n FROM (SELECT src AS v FROM simple UNION ALL SELECT dst FROM simple) GROUP BY v),
rising AS MATERIALIZED (SELECT CASE WHEN (a.n, src) < (b.n, dst) THEN src ELSE dst END AS low, CASE WHEN (a.n, src) < (b.n, dst) THEN dst ELSE src END AS high
  FROM simple JOIN degrees a ON a.v = src JOIN degrees b ON b.v = dst),
wedges AS (SELECT p.low AS x, p.high AS y, q.high AS z FROM rising p JOIN rising q ON p.low = q.low AND p.high < q.high)"""
BOTH = SIMPLE + ", both_ways AS (SELECT src, dst FROM simple UNION ALL SELECT dst, src FROM simple)"
SUPPLY = "supply AS (SELECT DISTINCT l_partkey AS src, l_suppkey + 1000000000 AS dst FROM lineitem)"
SUPPLY_BOTH = SUPPLY + ", ways AS (SELECT src, dst FROM supply UNION ALL SELECT dst, src FROM supply)"


def _bfs(edges: str, root: str) -> str:
    return f"""reach(v, dist) AS (SELECT {root}, 0 UNION SELECT e.dst, r.dist + 1 FROM reach r JOIN {edges} e ON e.src = r.v WHERE r.dist < 12),
  near AS (SELECT v, min(dist) AS dist FROM reach GROUP BY v),
  every AS (SELECT src AS v FROM {edges} UNION SELECT dst FROM {edges}),
  bfs AS (SELECT every.v, coalesce(near.dist, -1) AS dist FROM every LEFT JOIN near ON near.v = every.v)"""


def _mul(x: str, m: int) -> str:
    return f"((({x})::UHUGEINT * {m}) % 4294967296)::UBIGINT"


def _mix(x: str) -> str:
    a = f"(({x})::UBIGINT)"
    a = _mul(f"xor({a}, {a} >> 16)", 0x7FEB352D)
    a = _mul(f"xor({a}, {a} >> 15)", 0x846CA68B)
    return f"xor({a}, {a} >> 16)"


ROOT = "(SELECT min(src) FROM both_ways)"
SUPPLY_ROOT = "(SELECT min(src) FROM supply)"
VECTORS = "SELECT l_orderkey, l_linenumber, l_quantity AS a, l_extendedprice AS b, l_discount AS c FROM lineitem"
QUANT = "q AS (SELECT vec_id AS i, k - 1 AS k, floor(embedding[k]::DOUBLE * 127)::BIGINT AS v FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS k FROM embeddings))"
CAUSAL = QUANT.replace("* 127", "* 4") + """, s AS (SELECT a.i, b.i AS j, sum(a.v * b.v)::DOUBLE / 8 AS s FROM q a JOIN q b ON a.k = b.k WHERE b.i <= a.i GROUP BY a.i, b.i),
  e AS (SELECT i, j, exp(s - max(s) OVER (PARTITION BY i)) AS e FROM s), p AS (SELECT i, j, e / sum(e) OVER (PARTITION BY i) AS p FROM e),
  o AS (SELECT p.i, q.k AS d, sum(p.p * q.v) AS o FROM p JOIN q ON q.i = p.j GROUP BY p.i, q.k)"""
NAMES = "[" + ", ".join(f"'{n}'" for n in opcode_names()) + "]"
STATS = f"""stats AS (SELECT ({NAMES})[(l_partkey % {len(opcode_names())} + 1)::INT] || CASE WHEN l_linestatus = 'O' THEN '{SUFFIX}' ELSE '_cycles' END AS StatisticName,
  l_quantity::BIGINT AS sum_u64, l_orderkey AS SimTime FROM lineitem)"""
# The classes of opcodes, as patterns of their names without the suffix. LRW_RL has none.
KINDS = {
    "memory": "LB|LH|LW|LBU|LHU|SB|SH|SW|LWU|LD|SD|LRW(_AQ|_RL_AQ)?|(LRD|SCW|SCD|AMO(SWAP|ADD|XOR|AND|OR|MIN|MAX|MINU|MAXU|CAS)[WD])(_RL|_AQ|_RL_AQ)?",
    "integer": "LUI|AUIPC|FENCE|FENCE_I|ECALL|EBREAK|MRET|(ADD|SLT|XOR|OR|AND)I?|SLTI?U|SUB|S(LL|RL|RA)I?W?|ADDI?W|SUBW|CSRR[WSC]I?|MUL|MULH|MULHS?U|MULW|(DIV|REM)U?W?",
    "branch": "JALR?|BEQ|BNE|BLTU?|BGEU?",
    "float": "F[LS][WD]|FMV_(X_[WD]|[WD]_X)|(FMADD|FMSUB|FNMSUB|FNMADD|FADD|FSUB|FMUL|FDIV|FSQRT)_[SD]_(RNE|RTZ|RDN|RUP|RMM|DYN)|(FSGNJ|FSGNJN|FSGNJX|FMIN|FMAX|FEQ|FLE|FLT|FCLASS)_[SD]|FCVT_([SD]_(WU?|LU?)|(WU?|LU?)_[SD]|S_D|D_S)_(RNE|RTZ|RDN|RUP|RMM|DYN)",
}
KIND = "CASE " + " ".join(f"WHEN regexp_full_match(op, '({p})_instruction') THEN '{k}'" for k, p in KINDS.items()) + " END"
CLASSES = f"classes AS (SELECT op, {KIND} AS kind FROM (SELECT DISTINCT StatisticName AS op FROM stats))"
MIX = STATS + ", " + CLASSES + f""", mix AS (SELECT sum(sum_u64) AS total, """ + ", ".join(
    f"coalesce(sum(sum_u64) FILTER (kind = '{k}'), 0) AS {k}" for k in ("memory", "integer", "branch", "float")
) + f" FROM stats LEFT JOIN classes ON op = StatisticName WHERE StatisticName LIKE '%\\_instruction' ESCAPE '\\')"
# Addresses as unsigned words: 4 nodes (bits 60-59), 2 pods (58), 8 cores (57-55).
ADDR = """info AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag <> 'R' AS absolute, (['l1sp', 'l2sp', 'dram', 'ctrl'])[l_linenumber % 4 + 1] AS tier,
  (l_suppkey % 4)::UHUGEINT AS pxn, (l_partkey % 2)::UHUGEINT AS pod, (l_orderkey % 8)::UHUGEINT AS core, (l_partkey * 8)::UHUGEINT AS off FROM lineitem),
words AS (SELECT *, CASE WHEN absolute THEN 9223372036854775808::UHUGEINT + pxn * 576460752303423488 + CASE tier
    WHEN 'dram' THEN 4611686018427387904 + off
    WHEN 'l2sp' THEN 2305843009213693952 + pod * 288230376151711744 + off
    WHEN 'l1sp' THEN pod * 288230376151711744 + core * 36028797018963968 + off % 536870912
    ELSE pod * 288230376151711744 + core * 36028797018963968 + 536870912 END
  ELSE CASE tier WHEN 'dram' THEN 1073741824 + off % 1073741824 WHEN 'l2sp' THEN 536870912 + off % 536870912 ELSE off % 536870912 END END AS word FROM info)"""
SIGNED = "(CASE WHEN {0} >= 9223372036854775808 THEN {0}::HUGEINT - 18446744073709551616 ELSE {0}::HUGEINT END)::BIGINT"
#: A relative address keeps neither its node nor whether it was a control register.
SEEN = "seen AS (SELECT *, CASE WHEN NOT absolute AND tier = 'ctrl' THEN 'l1sp' ELSE tier END AS place FROM words)"


def _ego(fan: tuple[int, ...]) -> str:
    parts = ["heads AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS place FROM both_ways)", "s0 AS (SELECT DISTINCT src AS root, src AS v FROM both_ways)"]
    seen = "SELECT root, v FROM s0"
    for level, k in enumerate(fan):
        parts.append(f"d{level} AS (SELECT root, {level} AS level, src, dst FROM s{level} JOIN heads ON src = v AND place <= {k})")
        parts.append(f"s{level + 1} AS (SELECT DISTINCT root, dst AS v FROM d{level} EXCEPT ({seen}))")
        seen += f" UNION ALL SELECT root, v FROM s{level + 1}"
    return ", ".join(parts) + ", drawn AS (" + " UNION ALL ".join(f"SELECT * FROM d{i}" for i in range(len(fan))) + ")"


def _ranks(rounds: int) -> str:
    parts = ["deg AS (SELECT src, count(*) AS n FROM both_ways GROUP BY src)", "size AS (SELECT count(*) AS n FROM deg)", "r0 AS (SELECT src AS v, 1.0::DOUBLE / size.n AS rank FROM deg, size)"]
    for i in range(rounds):
        parts.append(f"r{i + 1} AS (SELECT dst AS v, 0.15::DOUBLE / any_value(size.n) + 0.85::DOUBLE * sum(rank / deg.n) AS rank FROM both_ways JOIN r{i} ON v = both_ways.src JOIN deg ON deg.src = both_ways.src, size GROUP BY dst)")
    return ", ".join(parts)


ORACLES = {
    "edges_symmetrize_both": f"WITH {BOTH} SELECT src, dst FROM both_ways",
    "edges_symmetrize_simple": f"WITH {SIMPLE} SELECT src, dst FROM simple",
    "graph_transpose": f"WITH {PAIRS} SELECT dst AS src, src AS dst FROM pairs",
    "graph_undirected_multi": f"WITH {PAIRS}, e AS (SELECT src, dst FROM pairs UNION ALL SELECT dst, src FROM pairs) SELECT src, count(*) AS degree FROM e WHERE src <> dst GROUP BY src",
    "graph_max_node": f"WITH {PAIRS} SELECT max(greatest(src, dst)) AS max_node FROM pairs",
    "csr_adjacency": f"WITH {BOTH} SELECT src, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS adj FROM both_ways GROUP BY src",
    "csr_offsets": f"WITH {BOTH}, g AS (SELECT src, count(*) AS degree FROM both_ways GROUP BY src) SELECT src, degree, (sum(degree) OVER (ORDER BY src) - degree)::BIGINT AS first_edge FROM g",
    "degree_relabel": f"WITH {BOTH}, g AS (SELECT src, count(*) AS degree FROM both_ways GROUP BY src) SELECT src, degree, (row_number() OVER (ORDER BY degree DESC, src DESC) - 1)::BIGINT AS new_id FROM g",
    "relabeled_edges": f"""WITH {BOTH}, g AS (SELECT src, row_number() OVER (ORDER BY count(*) DESC, src DESC) - 1 AS id FROM both_ways GROUP BY src)
SELECT a.id::BIGINT AS src, b.id::BIGINT AS dst FROM simple s JOIN g a ON a.src = s.src JOIN g b ON b.src = s.dst""",
    "grid_edges": """WITH c AS (SELECT range AS id, range // 25 AS r, range % 25 AS c FROM range(1000)), m AS (SELECT unnest([-1, 1, 0, 0]) AS dr, unnest([0, 0, -1, 1]) AS dc)
SELECT id AS src, ((r + dr) * 25 + c + dc)::BIGINT AS dst FROM c, m WHERE r + dr BETWEEN 0 AND 39 AND c + dc BETWEEN 0 AND 24""",
    "local_vertices": "SELECT p_partkey AS id, p_partkey >= 500 AND p_partkey < 1000 AS is_local FROM part",
    "matrix_market_round_trip": f"WITH {SUPPLY} SELECT src, dst - 1000000000 AS dst FROM supply",
    "weighted_matrix_round_trip": "SELECT l_orderkey AS row, l_linenumber::BIGINT AS col, l_quantity::FLOAT::DOUBLE AS val FROM lineitem",
    "coo_round_trip": "SELECT o_orderkey AS row, o_custkey AS col, 1.0::DOUBLE AS val FROM orders",
    "features_round_trip": """WITH e AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS node, embedding FROM embeddings WHERE embedding IS NOT NULL)
SELECT node, unnest(range(0, len(embedding))) AS k, unnest(embedding)::FLOAT::DOUBLE AS x FROM e""",
    "vertex_records_round_trip": "SELECT c_custkey AS id, c_custkey % 7 AS edges, c_custkey * 3 AS start, c_nationkey::INTEGER AS type FROM customer",
    "edge_records_round_trip": "SELECT l_orderkey AS src, l_partkey AS dst, l_linenumber AS type, 1::INTEGER AS src_type, 2::INTEGER AS dst_type, l_partkey * 4294967296 AS src_glbid, -l_suppkey AS dst_glbid FROM lineitem",
    "edge_image_round_trip": "SELECT l_orderkey AS src, l_partkey AS dst, l_linenumber AS type, 2::INTEGER AS src_type, 3::INTEGER AS dst_type, l_partkey * 4294967296 AS src_glbid, -l_suppkey AS dst_glbid FROM lineitem",
    "int8_matrix_round_trip": """WITH n AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount) - 1 AS i, [l_quantity::BIGINT, -l_linenumber, round(l_discount * 100)::BIGINT, l_partkey % 256 - 128] AS vs FROM lineitem)
SELECT i, j - 1 AS j, vs[j] AS v FROM (SELECT i, vs, unnest(range(1, 5)) AS j FROM n)""",
    "edge_list_round_trip": f"WITH {SUPPLY} SELECT src, dst FROM supply",
    "bfs_levels": f"WITH RECURSIVE {BOTH}, {_bfs('both_ways', ROOT)} SELECT dist, count(*) AS vertices FROM bfs GROUP BY dist",
    "bfs_push_distances": f"WITH RECURSIVE {SUPPLY_BOTH}, {_bfs('ways', SUPPLY_ROOT)} SELECT v, dist FROM bfs",
    "bfs_pull_distances": f"WITH RECURSIVE {SUPPLY_BOTH}, {_bfs('ways', SUPPLY_ROOT)} SELECT v, dist FROM bfs",
    "bfs_direction_stats": f"""WITH RECURSIVE {BOTH}, {_bfs('both_ways', ROOT)}, g AS (SELECT src, count(*) AS n FROM both_ways GROUP BY src),
  t AS (SELECT dist, count(*) AS frontier, sum(n)::BIGINT AS mf FROM bfs JOIN g ON g.src = bfs.v GROUP BY dist),
  u AS (SELECT dist AS level, frontier, mf, coalesce((SELECT sum(n) FROM bfs b JOIN g ON g.src = b.v WHERE b.dist > t.dist OR b.dist = -1), 0)::BIGINT AS mu FROM t WHERE dist >= 0),
  n AS (SELECT count(*) AS v FROM bfs),
  s AS (SELECT level, frontier, mf, mu, mf > mu // 20 AS rev FROM u WHERE level = 0
    UNION ALL SELECT u.level, u.frontier, u.mf, u.mu, CASE WHEN s.rev THEN u.frontier >= n.v // 20 ELSE u.mf > u.mu // 20 END FROM s JOIN u ON u.level = s.level + 1, n)
SELECT level, frontier, mf, mu, CASE WHEN rev THEN 'rev' ELSE 'fwd' END AS direction FROM s""",
    "bfs_grid_summary": "SELECT count(*) AS reached, max(r + c)::BIGINT AS max_dist, sum(r + c)::BIGINT AS sum_dist FROM (SELECT range AS r FROM range(12)), (SELECT range AS c FROM range(9))",
    "pagerank_5": f"WITH {BOTH}, {_ranks(5)} SELECT v, round(rank * 1e9)::BIGINT AS rank_e9 FROM r5",
    "pagerank_change": f"WITH {BOTH}, {_ranks(6)} SELECT round(sum(abs(r6.rank - r5.rank)) * 1e9)::BIGINT AS l1_e9, round(sum(r6.rank) * 1e6)::BIGINT AS total_e6 FROM r6 JOIN r5 USING (v)",
    "triangle_list": f"WITH {RISING} SELECT list_sort([x, y, z])[1] AS u, list_sort([x, y, z])[2] AS v, list_sort([x, y, z])[3] AS w FROM wedges JOIN simple c ON c.src = least(y, z) AND c.dst = greatest(y, z)",
    "triangle_count": f"WITH {SIMPLE} SELECT count(*) AS triangles FROM simple a JOIN simple b ON b.src = a.dst JOIN simple c ON c.src = a.src AND c.dst = b.dst",
    "triangle_intersection": f"WITH {SIMPLE} SELECT count(*) AS triangles FROM simple a JOIN simple b ON b.src = a.dst JOIN simple c ON c.src = a.src AND c.dst = b.dst",
    "triangle_multi": f"""WITH {PAIRS}, e AS (SELECT greatest(src, dst) AS n, least(src, dst) AS v, count(*) AS k FROM pairs WHERE src <> dst GROUP BY ALL)
SELECT coalesce(sum(a.k * b.k * c.k), 0)::BIGINT AS triangles FROM e a JOIN e b ON b.n = a.v JOIN e c ON c.n = a.n AND c.v = b.v""",
    "triangle_bipartite": f"""WITH {SUPPLY}, low AS MATERIALIZED (SELECT least(src, dst) AS src, greatest(src, dst) AS dst FROM supply)
SELECT count(*) AS triangles FROM low a JOIN low b ON b.src = a.dst JOIN low c ON c.src = a.src AND c.dst = b.dst""",
    "components_refine": f"""WITH RECURSIVE {BOTH}, i AS (SELECT src, dst FROM both_ways JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst WHERE a.p_size = b.p_size),
  r(v, low) AS (SELECT p_partkey, p_partkey FROM part UNION SELECT i.dst, r.low FROM r JOIN i ON i.src = r.v WHERE r.low < i.dst),
  m AS (SELECT v, min(low) AS low FROM r GROUP BY v)
SELECT v, (dense_rank() OVER (ORDER BY low) - 1)::BIGINT AS comm FROM m""",
    "partition_members": "SELECT p_size::BIGINT AS comm, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS members FROM part GROUP BY p_size",
    "ego_firstk": f"WITH {BOTH}, {_ego((5, 3, 2, 1))} SELECT root, level, src, dst FROM drawn",
    "ego_graph": f"""WITH {BOTH}, {_ego((2, 1))} SELECT root, src AS u, dst AS v FROM drawn UNION SELECT root, dst, src FROM drawn UNION SELECT root, src, src FROM drawn UNION SELECT root, dst, dst FROM drawn""",
    "ego_report": f"""WITH {BOTH}, {_ego((3, 2))}, n AS (SELECT DISTINCT root, src AS v FROM drawn UNION SELECT root, dst FROM drawn)
, r AS (SELECT (SELECT count(DISTINCT root) FROM drawn) AS roots, (SELECT count(*) FROM drawn) AS edges, (SELECT count(*) FROM n) AS vertices)
SELECT *, round(edges::DOUBLE / roots * 1e6)::BIGINT AS avg_edges_e6, round(vertices::DOUBLE / roots * 1e6)::BIGINT AS avg_vertices_e6 FROM r""",
    "cache_hits": """WITH t AS (SELECT l_partkey % 512 AS slot, l_partkey = lag(l_partkey) OVER (PARTITION BY l_partkey % 512 ORDER BY l_orderkey * 8 + l_linenumber, l_partkey) AS hit FROM lineitem)
SELECT slot, count(*) AS requests, coalesce(sum(hit::BIGINT), 0)::BIGINT AS hits FROM t GROUP BY slot""",
    "cache_hit_rate": """WITH t AS (SELECT l_partkey = lag(l_partkey) OVER (PARTITION BY l_partkey % 512 ORDER BY l_orderkey * 8 + l_linenumber, l_partkey) AS hit FROM lineitem)
SELECT count(*) FILTER (hit) AS hits, count(*) AS requests, round(hits * 100 / requests::DOUBLE * 1e6)::BIGINT AS percent_e6 FROM t""",
    "spmm": f"""WITH {BOTH}, s AS (SELECT b.src AS row, sum(p_size) AS x, count(*) AS y FROM both_ways b JOIN part ON p_partkey = b.dst GROUP BY b.src),
  z AS (SELECT p_partkey AS row, coalesce(x, 0)::BIGINT AS x, coalesce(y, 0)::BIGINT AS y FROM part LEFT JOIN s ON s.row = p_partkey)
SELECT row, 0::INTEGER AS k, x AS s FROM z UNION ALL SELECT row, 1::INTEGER, y FROM z""",
    "gemm_int8": f"WITH {QUANT} SELECT a.k AS i, b.k AS j, sum(a.v * b.v)::BIGINT AS v FROM q a JOIN q b ON a.i = b.i GROUP BY a.k, b.k",
    "gemm_tiled": f"WITH {QUANT} SELECT a.k AS i, b.k AS j, sum(a.v * b.v)::BIGINT AS v FROM q a JOIN q b ON a.i = b.i GROUP BY a.k, b.k",
    "gemm_checksum": f"WITH {QUANT} SELECT sum(a.v * b.v)::BIGINT AS checksum FROM q a JOIN q b ON a.i = b.i",
    "attention_q16": f"""WITH {QUANT}, s AS (SELECT a.i, b.i AS j, sum(a.v * b.v)::BIGINT * 8192 AS raw FROM q a JOIN q b ON a.k = b.k GROUP BY a.i, b.i),
  w AS (SELECT i, j, ((raw + 2147483648) & 4294967295) - 2147483648 AS s FROM s),
  x AS (SELECT i, j, s - max(s) OVER (PARTITION BY i) AS x FROM w),
  c AS (SELECT i, j, greatest(least(((x + 2147483648) & 4294967295) - 2147483648, 0), -524288) AS x FROM x),
  p2 AS (SELECT *, (x * x) >> 16 AS x2 FROM c), p3 AS (SELECT *, floor(x2 * x / 65536.0)::BIGINT AS x3 FROM p2), p4 AS (SELECT *, floor(x3 * x / 65536.0)::BIGINT AS x4 FROM p3),
  e AS (SELECT i, j, greatest(65536 + x + ((32768 * x2) >> 16) + floor(10922 * x3 / 65536.0)::BIGINT + ((2730 * x4) >> 16), 0) AS e FROM p4),
  p AS (SELECT i, j, CASE WHEN sum(e) OVER (PARTITION BY i) <= 0 THEN 65536 // count(*) OVER (PARTITION BY i) ELSE (e * 65536) // (sum(e) OVER (PARTITION BY i))::BIGINT END AS p FROM e),
  t AS (SELECT p.i, q.k AS d, p.j // 64 AS t, sum(p.p * q.v)::BIGINT AS acc FROM p JOIN q ON q.i = p.j GROUP BY ALL)
SELECT i, d, sum(floor(acc / 65536.0)::BIGINT)::BIGINT AS o FROM t GROUP BY i, d""",
    "attention_float": f"WITH {CAUSAL} SELECT i, d, round(o * 1e6)::BIGINT AS o_e6 FROM o",
    "attention_gradients": f"""WITH {CAUSAL}, g AS (SELECT i, k AS d, (i + k) % 5 - 2 AS g FROM q),
  inner_sums AS (SELECT i, sum(g * o) AS s FROM g JOIN o USING (i, d) GROUP BY i),
  dp AS (SELECT g.i, q.i AS j, sum(g * v) AS dp FROM g JOIN q ON q.k = g.d WHERE q.i <= g.i GROUP BY g.i, q.i),
  ds AS (SELECT i, j, p, p * (dp - inner_sums.s) / 8 AS ds FROM p JOIN dp USING (i, j) JOIN inner_sums USING (i)),
  every AS (SELECT 'q' AS part, ds.i AS id, q.k AS d, sum(ds * q.v) AS g FROM ds JOIN q ON q.i = ds.j GROUP BY ALL
    UNION ALL SELECT 'k', ds.j, q.k, sum(ds * q.v) FROM ds JOIN q ON q.i = ds.i GROUP BY ds.j, q.k
    UNION ALL SELECT 'v', ds.j, g.d, sum(p * g) FROM ds JOIN g ON g.i = ds.i GROUP BY ds.j, g.d)
SELECT part AS "of", id, d, round(g * 1e6)::BIGINT AS g_e6 FROM every""",
    "attention_heads": f"""WITH {QUANT.replace('* 127', '* 4')}, c AS (SELECT i // 32 AS b, i % 32 AS n, k // 20 AS part, k // 10 % 2 AS h, k % 10 AS d, v FROM q WHERE k < 60),
  s AS (SELECT x.b, x.h, x.n AS i, y.n AS j, sum(x.v * y.v)::DOUBLE / sqrt(10) AS s FROM c x JOIN c y ON x.b = y.b AND x.h = y.h AND x.d = y.d AND x.part = 0 AND y.part = 1 AND y.n <= x.n GROUP BY ALL),
  e AS (SELECT b, h, i, j, exp(s - max(s) OVER (PARTITION BY b, h, i)) AS e FROM s), p AS (SELECT b, h, i, j, e / sum(e) OVER (PARTITION BY b, h, i) AS p FROM e)
SELECT p.b, p.i AS n, p.h * 10 + c.d AS c, round(sum(p.p * c.v) * 1e6)::BIGINT AS o_e6 FROM p JOIN c ON c.b = p.b AND c.h = p.h AND c.n = p.j AND c.part = 2 GROUP BY ALL""",
    "stream_copy": f"SELECT l_orderkey, l_linenumber, a, b, a AS c FROM ({VECTORS})",
    "stream_scale": f"SELECT l_orderkey, l_linenumber, a, 3.0::DOUBLE * c AS b, c FROM ({VECTORS})",
    "stream_add": f"SELECT l_orderkey, l_linenumber, a, b, a + b AS c FROM ({VECTORS})",
    "stream_triad": f"SELECT l_orderkey, l_linenumber, b + 3.0::DOUBLE * c AS a, b, c FROM ({VECTORS})",
    "fma": f"SELECT l_orderkey, l_linenumber, a, b, c + a * b AS c FROM ({VECTORS})",
    "gups_xor": "SELECT p_partkey AS idx, coalesce(bit_xor(l_orderkey * 8 + l_linenumber), 0)::BIGINT AS val FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey",
    "gups_multi_node": "SELECT l_suppkey % 2 AS pxn, l_partkey AS idx, xor(bit_xor(l_orderkey * 8 + l_linenumber), 1)::BIGINT AS val FROM lineitem GROUP BY ALL",
    "list_rank": f"""WITH e AS (SELECT event_id AS id, user_id, ts, ({_mix('event_id')})::BIGINT AS val FROM events)
SELECT id, last_value(id) OVER w AS last, count(*) OVER w AS steps, (sum(val) OVER w)::BIGINT AS sum_val, bit_xor(id) OVER w AS xor_ids FROM e
WINDOW w AS (PARTITION BY user_id ORDER BY ts, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
    "ptr_chase": f"SELECT 0::BIGINT AS final_index, sum(i)::BIGINT AS sum_idx, sum({_mix('i')})::BIGINT AS sum_val FROM (SELECT range * 7 % 10000 AS i FROM range(10000))",
    "hash_mix32": f"SELECT o_orderkey, ({_mix('o_orderkey')})::BIGINT AS h, ({_mix('(123 + o_orderkey::HUGEINT * 2654435769) % 4294967296')})::BIGINT AS r FROM orders",
    "strided_read": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 7 = 0",
    "block_cyclic_read": "SELECT l_orderkey // 8 % 16 AS owner, count(*) AS n, sum(l_orderkey)::BIGINT AS total FROM lineitem GROUP BY ALL",
    "atomic_ops": """WITH o AS (SELECT l_suppkey AS addr, (['add', 'or', 'swap', 'max'])[l_linenumber % 4 + 1] AS op, l_quantity::BIGINT AS val, l_orderkey * 8 + l_linenumber AS t FROM lineitem)
SELECT addr, sum(val) FILTER (op = 'add')::BIGINT AS added, bit_or(val) FILTER (op = 'or') AS ored, (min(struct_pack(t := t, v := val)) FILTER (op = 'swap')).v AS first_swap,
  max(val) FILTER (op = 'max') AS maximum, count(*) AS ops FROM o GROUP BY addr""",
    "compare_and_swap": "SELECT l_partkey AS addr, min(struct_pack(t := l_orderkey * 8 + l_linenumber, v := l_suppkey)).v AS winner FROM lineitem GROUP BY l_partkey",
    "fib_14": "SELECT 377::BIGINT AS fib",
    "stats_tags_join": """WITH e AS (SELECT epoch_us(ts) // 60000000 AS SimTime, event_id, event_type FROM events)
SELECT s.SimTime, s.event_id AS stat_id, t.event_id AS tag_id FROM e s JOIN e t ON s.SimTime = t.SimTime AND s.event_type <> 'signup' AND t.event_type = 'signup'""",
    "opcode_mix": f"WITH {MIX} SELECT total::BIGINT AS total, memory::BIGINT AS memory, integer::BIGINT AS integer, branch::BIGINT AS branch, float::BIGINT AS float FROM mix",
    "opcode_shares": f"WITH {MIX} SELECT " + ", ".join(f"round({k}::DOUBLE / total::DOUBLE * 1e6)::BIGINT AS {k}" for k in ("memory", "integer", "branch", "float")) + " FROM mix",
    "stats_csv_round_trip": f"WITH {STATS} SELECT StatisticName, sum_u64, SimTime FROM stats",
    "addr_encode": f"WITH {ADDR} SELECT l_orderkey, l_linenumber, {SIGNED.format('word')} AS addr FROM words",
    "addr_decode": f"""WITH {ADDR}, {SEEN} SELECT l_orderkey, l_linenumber, {SIGNED.format('word')} AS addr, absolute, place AS tier,
  CASE WHEN absolute THEN pxn::BIGINT ELSE 0 END AS pxn, CASE WHEN absolute AND place <> 'dram' THEN pod::BIGINT ELSE 0 END AS pod,
  CASE WHEN absolute AND place IN ('l1sp', 'ctrl') THEN core::BIGINT ELSE 0 END AS core, CASE WHEN place = 'ctrl' THEN 0 ELSE off::BIGINT END AS place_offset FROM seen""",
    "addr_to_absolute": f"""WITH {ADDR}, {SEEN}, a AS (SELECT l_orderkey, l_linenumber, CASE WHEN absolute THEN word ELSE 9223372036854775808::UHUGEINT + pxn * 576460752303423488 + CASE place
  WHEN 'dram' THEN 4611686018427387904 + off WHEN 'l2sp' THEN 2305843009213693952 + 288230376151711744::UHUGEINT + off ELSE 288230376151711744::UHUGEINT + 3 * 36028797018963968::UHUGEINT + off END END AS w FROM seen)
SELECT l_orderkey, l_linenumber, {SIGNED.format('w')} AS addr FROM a""",
    "addr_roundtrip": "SELECT count(*) AS n, count(*) AS same FROM lineitem",
    "bank_of": "SELECT l_partkey * 64 // 256 % 8 AS bank, count(*) AS n FROM lineitem GROUP BY ALL",
    "bank_ranges": """WITH a AS (SELECT unnest(range(0, 8 * 1048576, 256)) AS start)
SELECT start // 256 % 8 AS bank, min(start) AS first, max(start) + 255 AS last FROM a GROUP BY bank""",
    "core_xy": "SELECT s_suppkey, s_suppkey % 8 AS x, s_suppkey // 8 AS y, s_suppkey AS core FROM supplier",
    "tier_pivot": f"""WITH {ADDR}, {SEEN}, a AS (SELECT l_suppkey % 16 AS thread, (['load', 'store', 'atomic'])[(l_orderkey % 3 + 1)::INT] || '_' || CASE WHEN absolute AND pxn <> 0 THEN 'remote_pxn' ELSE place END AS c FROM seen WHERE place <> 'ctrl')
SELECT thread, """ + ", ".join(f"count(*) FILTER (c = '{op}_{t}') AS {op}_{t}" for op in ("load", "store", "atomic") for t in ("l1sp", "l2sp", "dram", "remote_pxn")) + " FROM a GROUP BY thread",
    "tag_histogram": "SELECT (l_linenumber - 1)::BIGINT AS bin, count(*) AS n, sum(l_quantity::BIGINT)::BIGINT AS cycles FROM lineitem WHERE l_linenumber <= 4 GROUP BY ALL",
    "cycle_counters": "SELECT l_suppkey AS thread, sum(l_quantity::BIGINT)::BIGINT AS busy, sum(l_linenumber)::BIGINT AS stall, sum(l_linenumber % 2)::BIGINT AS icache_miss FROM lineitem GROUP BY l_suppkey",
    "tagged_snapshot": f"WITH {STATS} SELECT StatisticName, sum(sum_u64)::BIGINT AS sum_u64, 'end' AS TagName FROM stats GROUP BY StatisticName",
    "stat_catalogue": """SELECT upper(op || '_' || tier) AS name, 'instructions' AS units FROM (VALUES ('load'), ('store'), ('atomic')) o(op), (VALUES ('local_l1sp'), ('remote_l1sp'), ('l2sp'), ('dram'), ('remote_pxn')) t(tier)
UNION ALL VALUES ('STALL_CYCLES', 'cycles'), ('BUSY_CYCLES', 'cycles')""",
    "sweep_parameters": "SELECT p_partkey, p_size::BIGINT AS pod_cores, p_partkey AS threads FROM part",
    "spmm_balanced": f"""WITH {SUPPLY}, s AS (SELECT dst - 1000000000 AS row, sum(p_size)::BIGINT AS x, count(*) AS y FROM supply JOIN part ON p_partkey = src GROUP BY dst)
SELECT row, 0::INTEGER AS k, x AS s FROM s UNION ALL SELECT row, 1::INTEGER, y FROM s""",
    "triangle_bitmaps": f"WITH {SIMPLE} SELECT count(*) AS triangles FROM simple a JOIN simple b ON b.src = a.dst JOIN simple c ON c.src = a.src AND c.dst = b.dst",
    "stats_tags_as_of": """WITH e AS (SELECT epoch_us(ts) // 60000000 AS SimTime, event_id, event_type FROM events),
  t AS (SELECT SimTime AS m, max(event_id) AS tag_id FROM e WHERE event_type = 'signup' GROUP BY ALL)
SELECT s.SimTime, s.event_id AS stat_id, t.m AS "tag_SimTime", t.tag_id FROM (SELECT * FROM e WHERE event_type <> 'signup') s ASOF LEFT JOIN t ON s.SimTime >= t.m""",
    "sessions_overlapping": """WITH e AS (SELECT user_id, epoch_us(ts) AS t, event_type, value FROM events),
  n AS (SELECT user_id, t, coalesce(t - lag(t) OVER (PARTITION BY user_id ORDER BY t) >= 21600000000, true) AS new FROM e),
  g AS (SELECT user_id, t, sum(new::INT) OVER (PARTITION BY user_id ORDER BY t) AS g FROM n),
  s AS (SELECT user_id, min(t) AS s_from, max(t) + 21600000000 AS s_to FROM g GROUP BY user_id, g),
  p AS (SELECT t AS p_from, t + floor(value)::BIGINT * 60000000 AS p_to FROM e WHERE event_type = 'purchase')
SELECT user_id, s_from, count(*) AS n, sum(least(s_to, p_to) - greatest(s_from, p_from))::BIGINT AS micros FROM s JOIN p ON s_from < p_to AND p_from < s_to AND p_from < p_to GROUP BY ALL""",
    "balances_above": "SELECT s_nationkey, count(*) AS pairs, sum(c_custkey)::BIGINT AS keys FROM supplier JOIN customer ON s_acctbal > c_acctbal + 100 AND s_nationkey <> c_nationkey GROUP BY s_nationkey",
    "weekly_sketches": "SELECT datediff('day', DATE '2024-01-01', ts::DATE) // 7 AS span, count(*) AS n, true AS count_within, true AS ranks_within FROM events GROUP BY ALL",
    "stream_visits": """WITH e AS (SELECT user_id, epoch_us(ts) AS t, event_id, value FROM events),
  n AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) >= 10800000000, true) AS new FROM e),
  g AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY t, event_id) AS g FROM n),
  v AS (SELECT user_id, g, min(t) AS start, max(t) AS last, count(*) AS n, round(sum(value) * 100)::BIGINT AS total_e2 FROM g GROUP BY ALL)
SELECT user_id, start, last, n, total_e2 FROM v WHERE last // 1000 + 10800000 <= (SELECT max(t) // 1000 FROM e) OR (user_id, g + 1) IN (SELECT (user_id, g) FROM v)""",
    "stream_tags_near": """SELECT s.event_id AS stat_id, t.event_id AS tag_id, s.user_id FROM events s JOIN events t ON t.user_id = s.user_id AND s.event_type <> 'signup' AND t.event_type = 'signup'
  AND t.ts BETWEEN s.ts - INTERVAL 1 HOUR AND s.ts + INTERVAL 1 HOUR""",
    "tier_sets": f"""WITH {ADDR}, {SEEN}, a AS (SELECT l_suppkey % 4 AS node, l_suppkey % 16 AS thread, (['load', 'store', 'atomic'])[(l_orderkey % 3 + 1)::INT] || '_' || CASE WHEN absolute AND pxn <> 0 THEN 'remote_pxn' ELSE place END AS c FROM seen WHERE place <> 'ctrl')
SELECT node, thread, (['thread', 'node', 'all'])[(grouping(node) + grouping(thread) + 1)::INT] AS level, """ + ", ".join(f"count(*) FILTER (c = '{op}_{t}') AS {op}_{t}" for op in ("load", "store", "atomic") for t in ("l1sp", "l2sp", "dram", "remote_pxn")) + " FROM a GROUP BY ROLLUP (node, thread)",
    "counter_cube": """SELECT l_returnflag, l_linestatus, l_linenumber, grouping(l_returnflag, l_linestatus, l_linenumber)::INTEGER AS grouped, sum(l_quantity::BIGINT)::BIGINT AS total, count(*) AS n
FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus, l_linenumber)""",
    "pagerank_rounds": f"WITH {BOTH}, {_ranks(50).replace(' AS (', ' AS MATERIALIZED (')} " + " UNION ALL ".join(
        f"SELECT {i}::INTEGER AS round, round(sum(abs(r{i}.rank - r{i - 1}.rank)) * 1e7)::BIGINT AS l1_e7, round(sum(r{i}.rank) * 1e6)::BIGINT AS total_e6 FROM r{i} JOIN r{i - 1} USING (v)" for i in range(1, 51)
    ),
    "atomic_replay": """WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY addr ORDER BY t, op, val) AS n FROM (
    SELECT l_suppkey AS addr, (['add', 'or', 'swap', 'max', 'cas'])[l_partkey % 5 + 1] AS op, l_quantity::BIGINT AS val, l_orderkey * 8 + l_linenumber AS t FROM lineitem)),
  r(addr, n, t, op, val, old, new) AS (SELECT addr, 0::BIGINT, 0::BIGINT, '', 0::BIGINT, 0::BIGINT, 0::BIGINT FROM o GROUP BY addr
    UNION ALL SELECT o.addr, o.n, o.t, o.op, o.val, r.new, CASE o.op WHEN 'add' THEN r.new + o.val WHEN 'or' THEN r.new | o.val WHEN 'max' THEN greatest(r.new, o.val) WHEN 'swap' THEN o.val ELSE CASE WHEN r.new = 0 THEN o.val ELSE r.new END END
      FROM r JOIN o ON o.addr = r.addr AND o.n = r.n + 1)
SELECT addr, t, op, val, old, new FROM r WHERE n > 0""",
}
