"""The registered queries in DuckDB SQL, from the definitions."""

from __future__ import annotations

from basinforge.functions import energy
from basinforge.functions.sequence import PAIRS
from basinforge.plans.bindings import BASES, LETTERS

RT = energy.thermal_energy()


def _sequence(column: str) -> str:
    return f"translate(regexp_replace(upper({column}), '[^A-Z0-9]', '', 'g'), '{LETTERS}', '{BASES}')"


_PAIRS = ", ".join(f"'{p}'" for p in PAIRS)
_STACK = ", ".join(f"('{k}', {e})" for k, e in energy.stack_table().items())

RUNS = f"""runs AS (
  SELECT s_suppkey AS run_id, {_sequence("s_name")} AS seq_a, {_sequence("n_name")} AS seq_b
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

GRID = f"""{RUNS},
pos AS (
  SELECT run_id, i1, i2, substr(seq_a, i1, 1) AS a, substr(seq_b, i2, 1) AS b
  FROM (SELECT *, unnest(range(1, length(seq_a) + 1)) AS i1 FROM runs) x, LATERAL (SELECT unnest(range(1, length(x.seq_b) + 1)) AS i2) y),
stack AS (SELECT * FROM (VALUES {_STACK}) v(k, e)),
grid AS (
  SELECT run_id, i1, i2, a, b, a || b IN ({_PAIRS}) AS pairs, sum(coalesce(e, 0)) OVER (PARTITION BY run_id, i1 - i2 ORDER BY i1) AS along
  FROM (SELECT *, lag(a) OVER d || lag(b) OVER d || a || b AS k FROM pos WINDOW d AS (PARTITION BY run_id, i1 - i2 ORDER BY i1)) LEFT JOIN stack USING (k))"""

SITES = f"""{GRID},
sites AS MATERIALIZED (
  SELECT * FROM (
    SELECT l.run_id, l.i1, l.i2, r.i1 AS j1, r.i2 AS j2,
           CAST(m.along - l.along + 50 * abs((r.i1 - l.i1) - (r.i2 - l.i2)) AS BIGINT) AS hybrid,
           CAST(m.along - l.along + 50 * abs((r.i1 - l.i1) - (r.i2 - l.i2)) + 10 * (r.i1 - l.i1 + r.i2 - l.i2 + 2) AS BIGINT) AS energy
    FROM grid l JOIN grid r ON l.run_id = r.run_id AND r.i1 - l.i1 BETWEEN 2 AND 7 AND r.i2 - l.i2 BETWEEN 2 AND 7 AND abs((r.i1 - l.i1) - (r.i2 - l.i2)) <= 3
    JOIN grid m ON m.run_id = l.run_id AND m.i1 = l.i1 + least(r.i1 - l.i1, r.i2 - l.i2) AND m.i2 = l.i2 + least(r.i1 - l.i1, r.i2 - l.i2)
    WHERE l.pairs AND r.pairs)
  WHERE hybrid <= 700 AND energy <= 1200)"""

RANKED = f"""{SITES},
states AS (
  SELECT * FROM sites
  UNION ALL SELECT run_id, NULL, NULL, NULL, NULL, 0, -{energy.DUPLEX_INIT} FROM runs),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY i1 IS NOT NULL, energy, concat_ws(chr(9), printf('%.6f', energy / 100.0), i1, i2, j1, j2)) - 1 AS rank
  FROM states)"""

_LOOP = "CASE WHEN abs({0}) = 1 AND abs({1}) = 1 THEN 0 ELSE 100 + 20 * (abs({0}) + abs({1}) - 2) + 50 * abs(abs({0}) - abs({1})) END"


def _grow(kind: int, keys: tuple[str, str], ends: tuple[str, str], sign: str) -> str:
    d = [f"(t.{e} - s.{e})" for e in ends]
    return f"""
  SELECT s.run_id, s.rank AS src, t.rank AS dst, {kind} AS kind, s.energy AS e_src, t.energy AS e_dst,
         CASE WHEN {d[0]} {sign} 0 THEN t.hybrid + s.energy - s.hybrid ELSE s.hybrid + t.energy - t.hybrid END + {_LOOP.format(*d)} AS e_ts
  FROM ranked s JOIN ranked t ON s.run_id = t.run_id AND s.{keys[0]} = t.{keys[0]} AND s.{keys[1]} = t.{keys[1]}
  WHERE {d[0]} * {d[1]} > 0 AND abs({d[0]}) <= 7 AND abs({d[1]}) <= 7"""


def _shift(end: str) -> str:
    same = " AND ".join(f"s.{c} = t.{c}" for c in ("i1", "i2", "j1", "j2") if c != end)
    return f"""
  SELECT s.run_id, s.rank, t.rank, 2, s.energy, t.energy,
         CASE WHEN t.{end} - s.{end} {">" if end[0] == "i" else "<"} 0 THEN t.hybrid + s.energy - s.hybrid ELSE s.hybrid + t.energy - t.hybrid END
  FROM ranked s JOIN ranked t ON s.run_id = t.run_id AND {same} WHERE t.{end} <> s.{end} AND abs(t.{end} - s.{end}) <= 3"""


_SADDLE = "s.energy - s.hybrid + " + _LOOP.format("(s.j1 - s.i1)", "(s.j2 - s.i2)")
_SHORT = "t.i1 IS NULL AND s.j1 - s.i1 <= 7 AND s.j2 - s.i2 <= 7"
GROW = _grow(0, ("j1", "j2"), ("i1", "i2"), ">") + " UNION ALL " + _grow(1, ("i1", "i2"), ("j1", "j2"), "<")
SHIFT = " UNION ALL ".join(_shift(c) for c in ("i1", "i2", "j1", "j2"))
OPEN_CLOSE = f"""
  SELECT s.run_id, s.rank AS src, t.rank AS dst, 3 AS kind, s.energy AS e_src, t.energy AS e_dst, {_SADDLE} AS e_ts
  FROM ranked s JOIN ranked t ON s.run_id = t.run_id WHERE {_SHORT}
  UNION ALL
  SELECT s.run_id, t.rank, s.rank, 4, t.energy, s.energy, {_SADDLE} FROM ranked s JOIN ranked t ON s.run_id = t.run_id WHERE {_SHORT}"""

EDGES = f"""{RANKED},
edges AS ({GROW} UNION ALL {SHIFT} UNION ALL {OPEN_CLOSE})"""

_PARENTS = """parents AS MATERIALIZED (
  SELECT r.run_id, r.rank, CASE WHEN r.rank > 0 AND e.e_ts <= r.energy THEN e.dst ELSE r.rank END AS parent
  FROM ranked r LEFT JOIN (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, src ORDER BY e_ts, kind, dst) AS k FROM edges WHERE dst < src) WHERE k = 1) e
  ON r.run_id = e.run_id AND r.rank = e.src)"""
PARENTS = f"""{EDGES},
{_PARENTS}"""

_WALK = """walk AS (
  SELECT run_id, rank, parent FROM parents
  UNION ALL
  SELECT w.run_id, w.rank, p.parent FROM walk w JOIN parents p ON w.run_id = p.run_id AND w.parent = p.rank WHERE p.parent <> p.rank),
members AS (
  SELECT run_id, rank, root, dense_rank() OVER (PARTITION BY run_id ORDER BY root) - 1 AS basin
  FROM (SELECT run_id, rank, min(parent) AS root FROM walk GROUP BY run_id, rank))"""
BASINS = f"""{PARENTS},
{_WALK}"""

SUMMARY = f"""{BASINS},
summary AS (
  SELECT m.run_id, basin, count(*) AS n_states, sum(exp(-energy / 100.0 / {RT!r})) AS z, min(energy) AS min_energy, min(m.rank) AS min_rank
  FROM members m JOIN ranked r ON m.run_id = r.run_id AND m.rank = r.rank GROUP BY m.run_id, basin)"""

TRADE = """flow AS (
  SELECT CAST(least(c_nationkey, s_nationkey) AS BIGINT) AS a, CAST(greatest(c_nationkey, s_nationkey) AS BIGINT) AS b, CAST(count(*) AS DOUBLE) AS w
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
nodes AS (SELECT b, sum(w) AS z FROM (SELECT a AS b, w FROM flow UNION ALL SELECT b, w FROM flow) GROUP BY b),
edges AS (SELECT * FROM flow WHERE a <> b),
ends AS (SELECT a AS s, b AS t, w FROM edges UNION ALL SELECT b, a, w FROM edges),
rates AS (
  SELECT n.b, n.z, coalesce(o, 0) AS out_w, coalesce(o / n.z, 0) AS out_rate, coalesce(m / n.z, 0) AS max_rate
  FROM nodes n LEFT JOIN (SELECT s, sum(w) AS o, max(w) AS m FROM ends GROUP BY s) f ON n.b = f.s),
shares AS (SELECT b, z, z / sum(z) OVER () AS p FROM nodes)"""

#: The rate below which an edge of the trade graph is left out of its components.
SPARSE = 0.064
COMPONENTS = f"""{TRADE},
sparse AS (
  SELECT e.* FROM edges e JOIN nodes x ON e.a = x.b JOIN nodes y ON e.b = y.b WHERE w / least(x.z, y.z) >= {SPARSE}),
reach AS (
  SELECT b AS s, b AS t FROM nodes
  UNION
  SELECT r.s, e.t FROM reach r JOIN (SELECT a AS s, b AS t FROM sparse UNION ALL SELECT b, a FROM sparse) e ON r.t = e.s),
components AS (SELECT s AS b, min(t) AS component FROM reach GROUP BY s)"""

CHAIN = """chain AS (
  SELECT i, j, CAST(count(*) AS DOUBLE) AS v
  FROM (SELECT event_type AS i, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS j FROM events) WHERE j IS NOT NULL GROUP BY i, j),
sym AS (SELECT i, j, sum(v) / 2 AS v FROM (SELECT i, j, v FROM chain UNION ALL SELECT j, i, v FROM chain) GROUP BY i, j)"""

_DAY = "CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT)"
KINETICS = f"""kin AS (
  SELECT t, state, n / sum(n) OVER (PARTITION BY t) AS p FROM (SELECT {_DAY} AS t, event_type AS state, count(*) AS n FROM events GROUP BY 1, 2)),
ev AS (
  SELECT state, i, j, n / sum(n) OVER (PARTITION BY state) AS p
  FROM (SELECT event_type AS state, user_id % 7 AS i, CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 + 10 AS j, count(*) AS n FROM events GROUP BY 1, 2, 3))"""

COARSE = """part AS (
  SELECT CAST(n_regionkey AS BIGINT) AS coarse, CAST(n_nationkey AS BIGINT) AS fine, 0.75 AS part FROM nation
  UNION ALL SELECT (n_regionkey + 1) % 5, n_nationkey, 0.25 FROM nation),
fine AS (SELECT CAST(c_nationkey AS BIGINT) AS state, CAST(count(*) AS DOUBLE) AS z FROM customer GROUP BY 1),
total AS (SELECT coarse, sum(part * z) AS total FROM part JOIN fine ON fine = state GROUP BY coarse),
rk AS (
  SELECT t, state, n / sum(n) OVER (PARTITION BY t) AS p FROM (
    SELECT year(o_orderdate) AS t, CAST(n_regionkey AS BIGINT) AS state, count(*) AS n
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)),
ne AS (
  SELECT state, i, j, n / sum(n) OVER (PARTITION BY state) AS p FROM (
    SELECT CAST(s_nationkey AS BIGINT) AS state, CAST(ascii(l_returnflag) AS BIGINT) AS i, CAST(ascii(l_linestatus) AS BIGINT) AS j, count(*) AS n
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3)),
cp AS (SELECT state AS coarse, max(p) AS p FROM rk GROUP BY state HAVING max(p) >= 0.01)"""



def folds(strands: str) -> str:
    """CTEs over ``strands`` (a query of one column, strand): fold has each secondary structure with its weight and the set of its paired positions.

    Structures are derived interval by interval: the first position of an interval is
    unpaired, or it pairs and leaves the intervals within and behind.  An interval just
    within a pair is marked, for the stack if its own ends pair.
    """
    letter = lambda k: f"substr(strand, CAST({k} AS INT), 1)"
    close = f"exp(-4.0 / {RT!r})"
    return f"""stack2 AS (SELECT map_from_entries(list((k, e))) AS m FROM (VALUES {_STACK}) v(k, e)),
strands AS ({strands}),
derive AS (
  SELECT strand, [{{'i': 1, 'j': length(strand), 'f': false}}] AS todo, CAST(0 AS BIGINT) AS paired, CAST([] AS STRUCT(k BIGINT, l BIGINT)[]) AS pairs, CAST(1 AS DOUBLE) AS w FROM strands
  UNION ALL
  SELECT strand,
         CASE WHEN k < 0 THEN [] WHEN k = 0 THEN [{{'i': i + 1, 'j': j, 'f': false}}] ELSE [{{'i': i + 1, 'j': k - 1, 'f': true}}, {{'i': k + 1, 'j': j, 'f': false}}] END || todo[2:],
         CASE WHEN k <= 0 THEN paired ELSE paired + (1::BIGINT << CAST(i AS INT)) + (1::BIGINT << CAST(k AS INT)) END,
         CASE WHEN k <= 0 THEN pairs ELSE pairs || [{{'k': i, 'l': k}}] END,
         CASE WHEN k <= 0 THEN w WHEN f AND k = j THEN w * ({close} + exp(-(SELECT m FROM stack2)[{letter("i - 1")} || {letter("k + 1")} || {letter("i")} || {letter("k")}] / 100.0 / {RT!r})) ELSE w * {close} END
  FROM (SELECT *, todo[1].i AS i, todo[1].j AS j, todo[1].f AS f, unnest(CASE WHEN todo[1].i > todo[1].j THEN [-1] ELSE [0] || range(todo[1].i + 4, todo[1].j + 1) END) AS k FROM derive WHERE len(todo) > 0)
  WHERE k <= 0 OR {letter("i")} || {letter("k")} IN ({_PAIRS})),
fold AS (SELECT strand, paired, pairs, w FROM derive WHERE len(todo) = 0)"""


def windows(most: int) -> str:
    """CTE after ``folds``: unpaired has the probability that a window is unpaired."""
    return f"""masks AS (SELECT strand, paired, sum(w) AS w FROM fold GROUP BY ALL),
unpaired AS (
  SELECT s.strand, s.i, s.i + s.d AS j, sum(w) FILTER (WHERE paired & (((1::BIGINT << CAST(s.d + 1 AS INT)) - 1) << CAST(s.i AS INT)) = 0) / sum(w) AS p
  FROM (SELECT * FROM (SELECT strand, length(strand) AS n, unnest(range(1, length(strand) + 1)) AS i FROM strands), (SELECT unnest(range(0, {most})) AS d) WHERE i + d <= n) s
  JOIN masks m ON m.strand = s.strand GROUP BY s.strand, s.i, s.d)"""


TRADE_RUNS = """rflow AS (
  SELECT CAST(year(o_orderdate) AS BIGINT) AS run_id, CAST(least(c_nationkey, s_nationkey) AS BIGINT) AS a, CAST(greatest(c_nationkey, s_nationkey) AS BIGINT) AS b, CAST(count(*) AS DOUBLE) AS w
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
rnodes AS (SELECT run_id, b, sum(w) AS z FROM (SELECT run_id, a AS b, w FROM rflow UNION ALL SELECT run_id, b, w FROM rflow) GROUP BY ALL),
redges AS (SELECT * FROM rflow WHERE a <> b),
rends AS (SELECT run_id, a AS s, b AS t, w FROM redges UNION ALL SELECT run_id, b, a, w FROM redges)"""

def joint(asked: str) -> str:
    """CTE after ``folds``: joint has, for each row (strand, i, j, k, l) of the query ``asked``, p, that of both windows unpaired, and p1, that of the first."""
    mask = lambda i, j: f"(((1::BIGINT << CAST({j} - {i} + 1 AS INT)) - 1) << CAST({i} AS INT))"
    return f"""both_masks AS (SELECT strand, paired, sum(w) AS w FROM fold GROUP BY ALL),
asked AS ({asked}),
joint AS (
  SELECT s.strand, i, j, k, l, sum(w) FILTER (WHERE paired & ({mask("i", "j")} | {mask("k", "l")}) = 0) / sum(w) AS p, sum(w) FILTER (WHERE paired & {mask("i", "j")} = 0) / sum(w) AS p1
  FROM asked s JOIN both_masks m ON m.strand = s.strand GROUP BY ALL)"""


#: Each run's graph as lists: basins in order, rows of rates, and the waiting time and next basin's probabilities of each.
LISTS = f"""{TRADE_RUNS},
ids AS (SELECT run_id, b, z, CAST(row_number() OVER (PARTITION BY run_id ORDER BY b) AS INT) AS k FROM rnodes),
rate AS (
  SELECT x.run_id, x.k AS i, y.k AS j, coalesce(e.w, 0) AS w, coalesce(e.w, 0) / x.z AS r
  FROM ids x JOIN ids y ON x.run_id = y.run_id LEFT JOIN rends e ON e.run_id = x.run_id AND e.s = x.b AND e.t = y.b),
per AS (SELECT run_id, i, sum(r) AS o, list(r ORDER BY j) AS r, list(w ORDER BY j) AS w FROM rate GROUP BY run_id, i),
m AS MATERIALIZED (
  SELECT run_id, count(*) AS n, list(1 / o ORDER BY i) AS wait, list(list_transform(r, lambda x: x / o) ORDER BY i) AS hop,
         list(w ORDER BY i) AS w, max(o) AS most, list(list_transform(r, lambda x: x) ORDER BY i) AS r, list(o ORDER BY i) AS o FROM per GROUP BY run_id)"""

#: First passage times by repeated use of their equations: a wait, and then the times from where the chain goes.
PASSAGE = f"""{LISTS},
step AS (
  SELECT run_id, CAST(target AS INT) AS target, 0 AS k, list_transform(range(n), lambda x: CAST(0 AS DOUBLE)) AS v FROM m, (SELECT unnest(range(1, 26)) AS target) WHERE target <= n
  UNION ALL
  SELECT s.run_id, target, k + 1, list_transform(range(1, n + 1), lambda i: CASE WHEN i = target THEN 0 ELSE wait[i] + list_dot_product(hop[i], v) END) FROM step s JOIN m USING (run_id) WHERE k < 12000),
passage AS (
  SELECT x.run_id, x.b AS a, y.b AS b, v[x.k] AS time FROM (SELECT * FROM step WHERE k = 12000) s JOIN ids y ON y.run_id = s.run_id AND y.k = s.target JOIN ids x ON x.run_id = s.run_id)"""

#: Probabilities over time by uniformisation: jumps at one rate for all basins, some of which stay.
SOLVED = f"""{LISTS},
jump AS (
  SELECT run_id, 0 AS k, list_transform(range(n), lambda x: CAST(CASE WHEN x = 0 THEN 1 ELSE 0 END AS DOUBLE)) AS v FROM m
  UNION ALL
  SELECT g.run_id, k + 1, list_transform(range(1, n + 1), lambda j: v[j] * (1 - o[j] / most) + list_sum(list_transform(range(1, n + 1), lambda i: v[i] * r[i][j] / most))) FROM jump g JOIN m USING (run_id) WHERE k < 300),
times AS (SELECT 0.01 * pow(1.2, k) AS t FROM (SELECT unnest(range(0, 64)) AS k) WHERE 0.01 * pow(1.2, k) < 1e2),
poisson AS (SELECT g.run_id, t, g.k, exp(g.k * ln(most * t) - most * t - lgamma(g.k + 1)) AS q FROM times, jump g JOIN m USING (run_id)),
solved AS (SELECT p.run_id, t, x.b, sum(q * v[x.k]) / sum(q) AS p FROM poisson p JOIN jump g ON g.run_id = p.run_id AND g.k = p.k JOIN ids x ON x.run_id = p.run_id GROUP BY ALL)"""

#: Elimination of basins in ascending order of their first weight, one of each run after the other. A gone basin's paths go to the
#: pairs of its neighbours, each with itself too; edges below the least rate go at a basin's turn, and sums that stay below it are not taken.
_PRUNED = """{lists},
turns AS (SELECT run_id, list(k ORDER BY round(ln(z), 9), k) AS turns, sum(z) AS total, list(z ORDER BY k) AS z, list(b ORDER BY k) AS names FROM ids GROUP BY run_id),
cut AS (
  SELECT run_id, 0 AS k, z, w, list_transform(range(1, n + 1), lambda i: list_transform(range(1, n + 1), lambda j: CAST(CASE WHEN i = j THEN 1 ELSE 0 END AS DOUBLE))) AS part FROM m JOIN turns USING (run_id)
  UNION ALL
  SELECT run_id, k + 1, nz,
    list_transform(range(1, n + 1), lambda i: list_transform(range(1, n + 1), lambda j:
      CASE WHEN go AND (i = x OR j = x) THEN 0 WHEN i = x THEN wx[j] WHEN j = x THEN wx[i]
           WHEN NOT go OR f[i] = 0 OR f[j] = 0 THEN w[i][j]
           WHEN (w[i][j] + wx[i] * f[j] + wx[j] * f[i] + wx[x] * f[i] * f[j]) / least(nz[i], nz[j]) < {min_rate} THEN w[i][j]
           ELSE w[i][j] + wx[i] * f[j] + wx[j] * f[i] + wx[x] * f[i] * f[j] END)),
    list_transform(range(1, n + 1), lambda i: list_transform(range(1, n + 1), lambda j:
      CASE WHEN i = x THEN CASE WHEN go OR part[i][j] < 1e-3 THEN 0 ELSE part[i][j] END
           WHEN go AND part[x][j] * f[i] >= 1e-3 / n THEN part[i][j] + part[x][j] * f[i] ELSE part[i][j] END))
  FROM (SELECT *, list_transform(range(1, n + 1), lambda i: CASE WHEN NOT go THEN z[i] WHEN i = x THEN 0 ELSE z[i] + f[i] * z[x] END) AS nz
        FROM (SELECT *, list_transform(range(1, n + 1), lambda i: CASE WHEN i = x OR wx[i] = 0 THEN 0 ELSE wx[i] / flow END) AS f, {goes} AS go
              FROM (SELECT *, list_sum(list_transform(range(1, n + 1), lambda i: CASE WHEN i = x THEN 0 ELSE wx[i] END)) AS flow
                    FROM (SELECT c.*, m.n, t.total, t.names, turns[k + 1] AS x,
                                 list_transform(range(1, m.n + 1), lambda j: CASE WHEN c.w[turns[k + 1]][j] = 0 OR c.w[turns[k + 1]][j] / least(c.z[turns[k + 1]], c.z[j]) < {min_rate} THEN 0 ELSE c.w[turns[k + 1]][j] END) AS wx
                          FROM cut c JOIN m ON m.run_id = c.run_id JOIN turns t ON t.run_id = c.run_id WHERE k < m.n))))),
last AS (SELECT c.* FROM cut c JOIN m ON m.run_id = c.run_id WHERE c.k = m.n)"""
#: Basins under a share go, but for each run's first; or fast ones, with a least rate.
PRUNED = _PRUNED.format(lists=LISTS, goes="x <> 1 AND z[x] / total < 0.041", min_rate=0)
#: The same over the edges of at least that rate.
SPARSE_RUNS = 0.13
PRUNED_SPARSE = _PRUNED.format(
    lists=LISTS.replace("redges AS (SELECT * FROM rflow WHERE a <> b)", f"redges AS (SELECT f.* FROM rflow f JOIN rnodes x ON x.run_id = f.run_id AND x.b = f.a JOIN rnodes y ON y.run_id = f.run_id AND y.b = f.b WHERE f.a <> f.b AND w / least(x.z, y.z) >= {SPARSE_RUNS})"),
    goes="x <> 1 AND z[x] / total < 0.041", min_rate=0)
PRUNED_BY_FLOW = _PRUNED.format(lists=LISTS, goes="x <> 1 AND (z[x] / total < 0.02 OR flow / z[x] > 0.95)", min_rate=0.05)
#: All steps: prefactor, pruning, new numbers, exchange of the first two, and the components connected at the least rate.
PRUNE_RUN = _PRUNED.format(
    lists=PRUNED_SPARSE.split("turns AS (")[0].rstrip().rstrip(",").replace("SELECT f.* FROM rflow f", "SELECT f.run_id, f.a, f.b, CASE WHEN f.a = 0 THEN 2.5 * f.w ELSE f.w END AS w FROM rflow f").replace("WHERE f.a <> f.b AND w / least", "WHERE f.a <> f.b AND f.w / least"),
    goes="x <> 1 AND z[x] / total < 0.041", min_rate=0.05) + """,
kept AS (
  SELECT l.run_id, ids.k, l.z[ids.k] AS z, row_number() OVER (PARTITION BY l.run_id ORDER BY ids.k) - 1 AS pos, count(*) OVER (PARTITION BY l.run_id) AS n
  FROM last l JOIN ids ON ids.run_id = l.run_id WHERE l.z[ids.k] > 0),
named AS (SELECT *, CASE WHEN n > 1 AND pos < 2 THEN 1 - pos ELSE pos END AS b FROM kept),
links AS (
  SELECT x.run_id, x.b AS s, y.b AS t, l.w[x.k][y.k] AS w FROM last l JOIN named x ON x.run_id = l.run_id JOIN named y ON y.run_id = l.run_id WHERE l.w[x.k][y.k] > 0),
reach AS (
  SELECT run_id, b AS s, b AS t FROM named
  UNION
  SELECT r.run_id, r.s, e.t FROM reach r JOIN links e ON e.run_id = r.run_id AND e.s = r.t),
heads AS (
  SELECT n.run_id, c, arg_max(b, (z, -b)) AS b, max(z) AS z FROM named n JOIN (SELECT run_id, s, min(t) AS c FROM reach GROUP BY ALL) r ON r.run_id = n.run_id AND r.s = n.b GROUP BY n.run_id, c)"""  # fmt: skip
LEFT = """SELECT l.run_id, 'node' AS kind, b AS a, b, round(l.z[ids.k], 6) AS value FROM last l JOIN ids ON ids.run_id = l.run_id WHERE l.z[ids.k] > 0
UNION ALL SELECT l.run_id, CASE WHEN x.k = y.k THEN 'self' ELSE 'edge' END, x.b, y.b, round(l.w[x.k][y.k], 6)
FROM last l JOIN ids x ON x.run_id = l.run_id JOIN ids y ON y.run_id = l.run_id WHERE x.k <= y.k AND l.w[x.k][y.k] > 0"""
PARTS = "parts AS (SELECT l.run_id, x.b AS final, y.b AS basin, l.part[x.k][y.k] AS part, l.z[x.k] AS z FROM last l JOIN ids x ON x.run_id = l.run_id JOIN ids y ON y.run_id = l.run_id WHERE l.part[x.k][y.k] > 0)"

#: Basins that graphs are reduced to.
KEEP = (0, 3, 7, 11, 20)
REDUCED = _PRUNED.format(lists=LISTS, goes=f"NOT list_contains({list(KEEP)}, names[x])", min_rate=0)

#: States of up to two sites, at least six bases between them, and their moves; every pair of states of a run is looked at.
LONG_RUNS = f"""runs AS (
  SELECT s_suppkey AS run_id, {_sequence("s_name")} AS seq_a, {_sequence("n_name || r_name")} AS seq_b
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
_EIGHT = "i1, i2, j1, j2, k1, k2, l1, l2"


def _short(site: str) -> tuple[str, str]:
    a, b = f"(l.{site[2:4]} - l.{site[:2]})", f"(l.{site[6:8]} - l.{site[4:6]})"
    return f"{a} <= 7 AND {b} <= 7", _LOOP.format(a, b)


def _changed(site: tuple[str, ...], kinds: tuple[int, int]) -> str:
    """From each state l to the smaller s that differs in one end of that site."""
    others = [c for c in ("i1", "i2", "j1", "j2", "k1", "k2", "l1", "l2") if c not in site]
    same = " AND ".join(f"l.{c} IS NOT DISTINCT FROM s.{c}" for c in others)
    i1, i2, j1, j2 = site
    left, right = f"l.{i1} = s.{i1} AND l.{i2} = s.{i2}", f"l.{j1} = s.{j1} AND l.{j2} = s.{j2}"
    ends = []
    for kind, fixed, d in ((kinds[0], right, (f"(s.{i1} - l.{i1})", f"(s.{i2} - l.{i2})")), (kinds[1], left, (f"(l.{j1} - s.{j1})", f"(l.{j2} - s.{j2})"))):
        ends.append(f"SELECT l.run_id, l.rank AS l, s.rank AS s, {kind} AS there, {kind} AS back, l.energy AS el, s.energy AS es, s.hybrid + l.energy - l.hybrid + {_LOOP.format(*d)} AS e_ts FROM ranked l JOIN ranked s ON l.run_id = s.run_id AND {same} AND {fixed} WHERE {d[0]} BETWEEN 1 AND 5 AND {d[1]} BETWEEN 1 AND 5")
    for end, sign in ((i1, 1), (i2, 1), (j1, -1), (j2, -1)):
        fixed = " AND ".join(f"l.{c} = s.{c}" for c in site if c != end)
        ends.append(f"SELECT l.run_id, l.rank, s.rank, 4, 4, l.energy, s.energy, s.hybrid + l.energy - l.hybrid FROM ranked l JOIN ranked s ON l.run_id = s.run_id AND {same} AND {fixed} WHERE {sign} * (s.{end} - l.{end}) BETWEEN 1 AND 3")
    return " UNION ALL ".join(ends)


_ONE, _OTHER = _short("i1j1i2j2"), _short("k1l1k2l2")
TWO_STATES = f"""{SITES.replace(RUNS, LONG_RUNS)},
double AS (
  SELECT x.run_id, x.i1, x.i2, x.j1, x.j2, y.i1 AS k1, y.i2 AS k2, y.j1 AS l1, y.j2 AS l2, x.hybrid AS h1, y.hybrid AS h2, x.hybrid + y.hybrid AS hybrid, x.energy + y.energy AS energy
  FROM sites x JOIN sites y ON x.run_id = y.run_id AND y.i1 >= x.j1 + 7 AND y.i2 >= x.j2 + 7 WHERE x.energy + y.energy <= 1200),
states AS (
  SELECT * FROM double
  UNION ALL SELECT run_id, i1, i2, j1, j2, NULL, NULL, NULL, NULL, hybrid, NULL, hybrid, energy FROM sites
  UNION ALL SELECT run_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0, -{energy.DUPLEX_INIT} FROM runs),
ranked AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY i1 IS NOT NULL, energy, concat_ws(chr(9), printf('%.6f', energy / 100.0), {_EIGHT})) - 1 AS rank FROM states)"""
TWO_EDGES = f"""{TWO_STATES},
half AS (
  {_changed(("i1", "i2", "j1", "j2"), (0, 1))}
  UNION ALL {_changed(("k1", "k2", "l1", "l2"), (2, 3))}
  UNION ALL SELECT l.run_id, l.rank, s.rank, 5, 6, l.energy, s.energy, l.energy - l.hybrid + {_ONE[1]} FROM ranked l JOIN ranked s ON l.run_id = s.run_id AND s.i1 IS NULL WHERE l.k1 IS NULL AND {_ONE[0]}
  UNION ALL SELECT l.run_id, l.rank, s.rank, 5, 7, l.energy, s.energy, l.energy - l.hybrid + {_ONE[1]} + l.h2
    FROM ranked l JOIN ranked s ON l.run_id = s.run_id AND s.k1 IS NULL AND s.i1 = l.k1 AND s.i2 = l.k2 AND s.j1 = l.l1 AND s.j2 = l.l2 WHERE {_ONE[0]}
  UNION ALL SELECT l.run_id, l.rank, s.rank, 5, 8, l.energy, s.energy, l.energy - l.hybrid + {_OTHER[1]} + l.h1
    FROM ranked l JOIN ranked s ON l.run_id = s.run_id AND s.k1 IS NULL AND s.i1 = l.i1 AND s.i2 = l.i2 AND s.j1 = l.j1 AND s.j2 = l.j2 WHERE {_OTHER[0]}
  UNION ALL SELECT l.run_id, l.rank, s.rank, 9, 10, l.energy, s.energy, s.energy - s.hybrid + l.hybrid + n.along - m.along
    FROM ranked l JOIN ranked s ON l.run_id = s.run_id AND s.k1 IS NULL AND s.i1 = l.i1 AND s.i2 = l.i2 AND s.j1 = l.l1 AND s.j2 = l.l2
    JOIN grid m ON m.run_id = l.run_id AND m.i1 = l.j1 AND m.i2 = l.j2 JOIN grid n ON n.run_id = l.run_id AND n.i1 = l.k1 AND n.i2 = l.k2
    WHERE l.k1 = l.j1 + 7 AND l.k2 = l.j2 + 7),
edges AS (
  SELECT run_id, l AS src, s AS dst, there AS kind, el AS e_src, es AS e_dst, CAST(e_ts AS BIGINT) AS e_ts FROM half
  UNION ALL SELECT run_id, s, l, back, es, el, CAST(e_ts AS BIGINT) FROM half)"""
TWO_BASINS = f"""{TWO_EDGES},
{_PARENTS},
{_WALK}"""
