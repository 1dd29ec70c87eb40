"""All registered queries of the engine and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basinforge.functions import energy, sequence
from basinforge.functions.loops import LoopTable
from basinforge.operators import analysis, checks, ctmc, events, graph, hybrid, landscape, two_sites
from basinforge.operators.lineage import checkpointed
from basinforge.plans import bindings as B
from basinforge.plans import sql as S
from basinforge.sources import exports

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "basin_equilibrium"
SITE = landscape.SITE


def tidy(df: DataFrame, digits: int = 8) -> DataFrame:
    """Whole numbers as long and fractions rounded, so that rows compare across engines."""

    def one(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, digits)
        return c.alias(f.name)

    return df.select(*map(one, df.schema.fields))


def query(name: str, sql: str | None = None, digits: int = 8):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: tidy(fn(spark, sf_dir), digits)
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return register


def runs_query(name: str, sql: str | None = None, digits: int = 8, runs: Callable[[SparkSession, str], DataFrame] = B.runs):
    """A query that works on each different pair of strands once; its rows are then those of every run of that pair."""

    def register(fn: Callable[[DataFrame], DataFrame]):
        def every(spark: SparkSession, sf_dir: str) -> DataFrame:
            different, same = landscape.different_runs(runs(spark, sf_dir))
            return landscape.of_every_run(tidy(fn(different), digits), same)

        QUERIES[name] = every
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return register


# sequences and states

_TEXT = "translate(regexp_replace(text, '[^A-Za-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"


@query("seq_normalize", "SELECT doc_id, sha256(replace(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), 'T', 'U')) AS normalized FROM documents")
def seq_normalize(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", F.sha2(sequence.normalize(F.col("text")), 256).alias("normalized"))


@query("seq_revcomp", f"SELECT doc_id, sha256(reverse(translate(translate({_TEXT}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '{B.BASES[:26]}'), 'ACGTU', 'UGCAA'))) AS revcomp FROM documents")
def seq_revcomp(spark, sf):
    letters = F.regexp_replace("text", "[^A-Za-z]", "")
    letters = F.translate(letters, B.LETTERS[:26].lower() + B.LETTERS[:26], B.BASES[:26] * 2)
    return B.table(spark, sf, "documents").select("doc_id", F.sha2(sequence.reverse_complement(letters), 256).alias("revcomp"))


@query("seq_validate", "SELECT page_id, coalesce(regexp_full_match(split_part(url, '/', -1), '[ACGUacgu]+'), false) AS tail_valid, false AS url_valid FROM pages")
def seq_validate(spark, sf):
    tail = F.split_part(F.col("url"), F.lit("/"), F.lit(-1))
    return B.table(spark, sf, "pages").select("page_id", sequence.is_sequence(tail).alias("tail_valid"), sequence.is_sequence(F.col("url")).alias("url_valid"))


@query("pairable_positions", f"WITH {S.GRID} SELECT run_id, i1, i2 FROM grid WHERE pairs")
def pairable_positions(spark, sf):
    return landscape.pairable_positions(B.runs(spark, sf))


def _sites(r):
    return landscape.enumerate_sites(r)


def _ranked(r):
    return checkpointed(landscape.rank_states(landscape.with_open_state(r, landscape.enumerate_sites(r))))


@query("input_modes", f"""WITH {S.RUNS}, s AS (SELECT run_id, seq_a AS a, seq_b AS b FROM runs)
SELECT run_id, 'pair' AS mode, a AS seq_a, reverse(b) AS seq_b, reverse(a) = reverse(b) AS homodimer FROM s
UNION ALL SELECT run_id, 'homodimer', a, reverse(a), true FROM s
UNION ALL SELECT run_id, 'antisense', a, translate(a, 'ACGU', 'UGCA'), reverse(a) = translate(a, 'ACGU', 'UGCA') FROM s""")  # fmt: skip
def input_modes(spark, sf):
    strands = B.runs(spark, sf)
    modes = [landscape.input_runs(strands, m).withColumn("mode", F.lit(m)) for m in ("pair", "homodimer", "antisense")]
    both = modes[0].unionByName(modes[1]).unionByName(modes[2])
    return both.withColumn("homodimer", landscape.is_homodimer(both))


@runs_query("enumerate_single_sites", f"WITH {S.SITES} SELECT * FROM sites")
def enumerate_single_sites(r):
    return _sites(r)


@runs_query("enumerate_double_sites", f"""WITH {S.SITES} SELECT x.run_id, x.i1, x.i2, x.j1, x.j2, y.i1 AS k1, y.i2 AS k2, y.j1 AS l1, y.j2 AS l2
FROM sites x JOIN sites y ON x.run_id = y.run_id AND y.i1 >= x.j1 + 2 AND y.i2 >= x.j2 + 2""")  # fmt: skip
def enumerate_double_sites(r):
    return landscape.enumerate_double_sites(_sites(r), landscape.SiteLimits(distance=1))


@query("state_validity", f"""WITH {S.GRID} SELECT l.run_id, l.i1, l.i2, r.i1 AS j1, r.i2 AS j2,
  r.i1 - l.i1 >= 2 AND r.i2 - l.i2 >= 2 AS valid
FROM grid l JOIN grid r ON l.run_id = r.run_id AND r.i1 - l.i1 BETWEEN 0 AND 3 AND r.i2 - l.i2 BETWEEN 0 AND 3 WHERE l.pairs AND r.pairs""")  # fmt: skip
def state_validity(spark, sf):
    r = B.runs(spark, sf)
    pairs = landscape.pairable_positions(r)
    step = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in range(4) for y in range(4)])
    left = pairs.select("run_id", "i1", "i2", F.explode(step).alias("d")).select("run_id", "i1", "i2", (F.col("i1") + F.col("d.x")).alias("j1"), (F.col("i2") + F.col("d.y")).alias("j2"))
    both = left.join(pairs.select("run_id", F.col("i1").alias("j1"), F.col("i2").alias("j2")), ["run_id", "j1", "j2"]).join(r, "run_id")
    return both.select("run_id", *SITE, landscape.is_valid(F.length("seq_a"), F.length("seq_b")).alias("valid"))


@runs_query("rank_states", f"WITH {S.RANKED} SELECT run_id, coalesce(i1, 0) AS i1, coalesce(i2, 0) AS i2, coalesce(j1, 0) AS j1, coalesce(j2, 0) AS j2, energy, rank FROM ranked")
def rank_states(r):
    return _ranked(r).select("run_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in SITE], "energy", "rank")


@query("dotbracket", f"""WITH {S.SITES} SELECT s.run_id, i1, i2, j1, j2,
  repeat('.', i1 - 1) || '(' || repeat('.', j1 - i1 - 1) || '(' || repeat('.', length(seq_a) - j1) || '&' ||
  repeat('.', i2 - 1) || ')' || repeat('.', j2 - i2 - 1) || ')' || repeat('.', length(seq_b) - j2) AS brackets,
  '{{(' || i1 || ',' || i2 || ')-(' || j1 || ',' || j2 || ')}}' AS name
FROM sites s JOIN runs r ON s.run_id = r.run_id""")  # fmt: skip
def dotbracket(spark, sf):
    both = _sites(B.runs(spark, sf)).join(B.runs(spark, sf), "run_id")
    brackets = sequence.dot_bracket(F.length("seq_a"), F.length("seq_b"), *[F.col(c) for c in SITE])
    return both.select("run_id", *SITE, brackets.alias("brackets"), sequence.state_text(F.array(F.struct(*SITE))).alias("name"))


@query("symmetric_states", f"WITH {S.SITES} SELECT s.run_id, length(seq_a) - j2 + 1 AS i1, length(seq_a) - j1 + 1 AS i2, length(seq_a) - i2 + 1 AS j1, length(seq_a) - i1 + 1 AS j2 FROM sites s JOIN runs r ON s.run_id = r.run_id")
def symmetric_states(spark, sf):
    both = _sites(B.runs(spark, sf)).join(B.runs(spark, sf), "run_id")
    return both.select("run_id", *[c.alias(n) for c, n in zip(sequence.symmetric(*[F.col(c) for c in SITE], F.length("seq_a")), SITE)])


@query("reorient_states", f"WITH {S.SITES} SELECT s.run_id, i1, length(seq_b) - j2 + 1 AS i2, j1, length(seq_b) - i2 + 1 AS j2 FROM sites s JOIN runs r ON s.run_id = r.run_id")
def reorient_states(spark, sf):
    both = _sites(B.runs(spark, sf)).join(B.runs(spark, sf), "run_id")
    return both.select("run_id", *[c.alias(n) for c, n in zip(sequence.reorient(*[F.col(c) for c in SITE], F.length("seq_b")), SITE)])


@runs_query("region_filter", f"WITH {S.SITES} SELECT * FROM sites WHERE i1 >= 9 AND j1 <= 16 AND i2 >= 1 AND j2 <= 7")
def region_filter(r):
    return _sites(r).where(~landscape.outside_region((9, 16), (1, 7)))


@runs_query("encode_states", f"WITH {S.SITES} SELECT run_id, (i1 << 48) | (i2 << 32) | (j1 << 16) | j2 AS code, i1, j2, greatest(j1 - i1, j2 - i2) + 1 AS max_size FROM sites")
def encode_states(r):
    code = sequence.encode_site(*[F.col(c) for c in SITE])
    decoded = sequence.decode_site(F.col("code"))
    coded = _sites(r).select("run_id", code.alias("code"), (F.greatest(F.col("j1") - F.col("i1"), F.col("j2") - F.col("i2")) + 1).alias("max_size"))
    return coded.select("run_id", "code", decoded[0].alias("i1"), decoded[3].alias("j2"), "max_size")


@runs_query("state_energy", f"WITH {S.RANKED} SELECT run_id, rank, energy / 100.0 AS energy, round(exp(-energy / 1000.0 / {S.RT!r}), 8) AS scaled_weight FROM ranked")
def state_energy(r):
    e = F.col("energy") / 100.0
    return _ranked(r).select("run_id", "rank", e.alias("energy"), energy.boltzmann(e / 10).alias("scaled_weight"))


@query("boltzmann_weights", f"SELECT s_suppkey, round(exp(-s_acctbal / 1000 / {S.RT!r}), 8) AS weight FROM supplier")
def boltzmann_weights(spark, sf):
    return B.table(spark, sf, "supplier").select("s_suppkey", energy.boltzmann(F.col("s_acctbal") / 1000).alias("weight"))


_PATHS = f"""WITH RECURSIVE {S.GRID},
path AS (
  SELECT run_id, i1, i2, i1 AS j1, i2 AS j2, CAST(1 AS DOUBLE) AS w FROM grid WHERE pairs
  UNION ALL
  SELECT p.run_id, p.i1, p.i2, r.i1, r.i2,
         p.w * exp(-CASE WHEN r.i1 = p.j1 + 1 AND r.i2 = p.j2 + 1 THEN k.e ELSE 100 + 20 * (r.i1 - p.j1 + r.i2 - p.j2 - 2) + 50 * abs((r.i1 - p.j1) - (r.i2 - p.j2)) END / 100.0 / {S.RT!r})
  FROM path p JOIN grid l ON l.run_id = p.run_id AND l.i1 = p.j1 AND l.i2 = p.j2
  JOIN grid r ON r.run_id = p.run_id AND r.pairs AND r.i1 > p.j1 AND r.i2 > p.j2 AND r.i1 - p.j1 + r.i2 - p.j2 - 2 <= 6 AND r.i1 - p.i1 <= 7 AND r.i2 - p.i2 <= 7
  LEFT JOIN stack k ON k.k = l.a || l.b || r.a || r.b),
hybrid AS (SELECT run_id, i1, i2, j1, j2, sum(w) AS q FROM path GROUP BY ALL)"""


def _hybrid(r):
    return hybrid.hybrid_partition(r, landscape.pairable_positions(r))


@runs_query("hybrid_pf", f"{_PATHS} SELECT run_id, i1, i2, j1, j2, round(-{S.RT!r} * ln(q), 6) AS energy FROM hybrid", 6)
def hybrid_pf(r):
    return _hybrid(r).select("run_id", *SITE, energy.free_energy(F.col("q")).alias("energy"))


_PARAMETERS = """kept AS (SELECT p_size % 6 + 1 AS n, p_retailprice AS v, CAST(p_partkey % 96 AS INT) AS k FROM part),
mean AS (SELECT map_from_entries(list((CAST(n AS INT), CAST(v AS INT)))) AS m FROM (SELECT n, floor(avg(v)) AS v FROM kept GROUP BY n)),
counts AS (SELECT k, count(*) AS c, ['AU', 'CG', 'GC', 'GU', 'UA', 'UG'][k % 6 + 1] AS pair, ['A', 'C', 'G', 'U'][k // 6 % 4 + 1] || ['A', 'C', 'G', 'U'][k // 24 % 4 + 1] AS behind FROM kept GROUP BY k),
mismatch AS (SELECT map_from_entries(list((pair || behind, CAST(-(c * 7 + k) % 90 AS INT)))) AS m FROM counts),
terminal AS (SELECT map_from_entries(list((pair, CAST(c % 60 AS INT)))) AS m FROM counts WHERE k < 6)"""
_D1, _D2 = "(r.i1 - p.j1)", "(r.i2 - p.j2)"
_TABLE_STEP = f"""CASE WHEN {_D1} = 1 AND {_D2} = 1 THEN k.e
  WHEN {_D1} = 1 OR {_D2} = 1 THEN (SELECT m FROM mean)[{_D1} + {_D2} - 2] % 200 + 200 + CASE WHEN {_D1} + {_D2} = 3 THEN k.e ELSE (SELECT m FROM terminal)[l.a || l.b] + (SELECT m FROM terminal)[r.a || r.b] END
  ELSE (SELECT m FROM mean)[{_D1} + {_D2} - 2] % 150 + 90 + 50 * abs({_D1} - {_D2})
    + coalesce((SELECT m FROM mismatch)[l.a || l.b || substr(z.seq_a, CAST(p.j1 + 1 AS INT), 1) || substr(z.seq_b, CAST(p.j2 + 1 AS INT), 1)], 0)
    + coalesce((SELECT m FROM mismatch)[r.b || r.a || substr(z.seq_b, CAST(r.i2 - 1 AS INT), 1) || substr(z.seq_a, CAST(r.i1 - 1 AS INT), 1)], 0) END"""
_PLAIN_STEP = "CASE WHEN r.i1 = p.j1 + 1 AND r.i2 = p.j2 + 1 THEN k.e ELSE 100 + 20 * (r.i1 - p.j1 + r.i2 - p.j2 - 2) + 50 * abs((r.i1 - p.j1) - (r.i2 - p.j2)) END"


def _loop_table(spark, sf) -> LoopTable:
    return LoopTable.from_rows(map(tuple, B.loop_rows(spark, sf).collect()))  # about a hundred rows at any scale


@query("hybrid_pf_tables", f"""{_PATHS.replace(_PLAIN_STEP, _TABLE_STEP).replace("LEFT JOIN stack k", "JOIN runs z ON z.run_id = p.run_id LEFT JOIN stack k").replace("path AS (", _PARAMETERS + ",\npath AS (", 1)}
SELECT run_id, i1, i2, j1, j2, round(-{S.RT!r} * ln(q), 6) AS energy FROM hybrid""", 6)  # fmt: skip
def hybrid_pf_tables(spark, sf):
    r = B.runs(spark, sf)
    found = hybrid.hybrid_partition(r, landscape.pairable_positions(r), hybrid.HybridSpec(table=_loop_table(spark, sf)))
    return found.select("run_id", *SITE, energy.free_energy(F.col("q")).alias("energy"))


_STEP_TO = f"JOIN grid r ON r.run_id = p.run_id AND r.pairs AND r.i1 > p.j1 AND r.i2 > p.j2 AND r.i1 - p.j1 + r.i2 - p.j2 - 2 <= 6 LEFT JOIN stack k ON k.k = l.a || l.b || r.a || r.b"
_FREE = "(SELECT unnest(range(0, 7)) AS u1) JOIN (SELECT unnest(range(0, 7)) AS u2) ON true"


@runs_query("conditional_hybrid_pf", f"""{_PATHS},
ends AS (
  SELECT 'right' AS side, p.run_id, p.i1, p.i2, r.i1 AS j1, r.i2 AS j2, {_D1} AS d1, {_D2} AS d2, p.q * exp(-{_PLAIN_STEP} / 100.0 / {S.RT!r}) AS q
  FROM hybrid p JOIN grid l ON l.run_id = p.run_id AND l.i1 = p.j1 AND l.i2 = p.j2 {_STEP_TO} WHERE r.i1 - p.i1 <= 7 AND r.i2 - p.i2 <= 7
  UNION ALL
  SELECT 'left', p.run_id, p.j1, p.j2, h.j1, h.j2, {_D1}, {_D2}, h.q * exp(-{_PLAIN_STEP} / 100.0 / {S.RT!r})
  FROM (SELECT run_id, i1 AS j1, i2 AS j2 FROM grid WHERE pairs) p JOIN grid l ON l.run_id = p.run_id AND l.i1 = p.j1 AND l.i2 = p.j2 {_STEP_TO}
  JOIN hybrid h ON h.run_id = p.run_id AND h.i1 = r.i1 AND h.i2 = r.i2 WHERE h.j1 - p.j1 <= 7 AND h.j2 - p.j2 <= 7)
SELECT side, run_id, i1, i2, j1, j2, u1, u2, round(-{S.RT!r} * ln(sum(q)), 6) AS energy FROM ends, (SELECT * FROM {_FREE}) WHERE d1 > u1 AND d2 > u2 GROUP BY ALL""", 6)  # fmt: skip
def conditional_hybrid_pf(r):
    pairs = landscape.pairable_positions(r)
    right, left = (hybrid.conditional_hybrid(r, pairs, left=at_left).withColumn("side", F.lit(side)) for side, at_left in (("right", False), ("left", True)))
    return right.unionByName(left).select("side", "run_id", *SITE, "u1", "u2", energy.free_energy(F.col("q")).alias("energy"))


@runs_query("interaction_probability", f"""{_PATHS}
SELECT l.run_id, l.i1, l.i2, w.j1, w.j2, l.j1 AS k1, l.j2 AS k2, round(l.q * r.q / w.q, 6) AS p
FROM hybrid l JOIN hybrid r ON l.run_id = r.run_id AND l.j1 = r.i1 AND l.j2 = r.i2
JOIN hybrid w ON w.run_id = l.run_id AND w.i1 = l.i1 AND w.i2 = l.i2 AND w.j1 = r.j1 AND w.j2 = r.j2""", 6)  # fmt: skip
def interaction_probability(r):
    return hybrid.interaction_probability(checkpointed(_hybrid(r)))


_STRANDS = "SELECT seq_a AS strand FROM runs UNION SELECT seq_b FROM runs"


@query("unpaired_probabilities", f"WITH RECURSIVE {S.RUNS}, {S.folds(_STRANDS)}, {S.windows(4)} SELECT strand, i, j, round(p, 8) AS p FROM unpaired", 8)
def unpaired_probabilities(spark, sf):
    return hybrid.unpaired_probabilities(B.runs(spark, sf))


@query("local_unpaired_probabilities", f"""WITH RECURSIVE {S.RUNS}, whole AS ({_STRANDS}),
piece AS (SELECT strand, s, substr(strand, CAST(s AS INT), 10) AS letters FROM (SELECT strand, unnest(range(1, greatest(length(strand) - 10, 0) + 2)) AS s FROM whole)),
{S.folds("SELECT DISTINCT letters AS strand FROM piece")}, {S.windows(4)}
SELECT w.strand, u.i + s - 1 AS i, u.j + s - 1 AS j, round(avg(p), 8) AS p FROM piece w JOIN unpaired u ON u.strand = w.letters GROUP BY ALL""", 8)  # fmt: skip
def local_unpaired_probabilities(spark, sf):
    return hybrid.unpaired_probabilities(B.runs(spark, sf), window=10)


_TWO_WINDOWS = """SELECT x.strand, x.i, x.i + x.d AS j, y.i AS k, y.i + y.d AS l FROM
  (SELECT *, unnest(range(2, 4)) AS d FROM (SELECT strand, unnest(range(1, length(strand) + 1)) AS i FROM strands)) x
  JOIN (SELECT *, unnest(range(2, 4)) AS d FROM (SELECT strand, unnest(range(1, length(strand) + 1)) AS i FROM strands)) y ON x.strand = y.strand AND y.i > x.i + x.d + 2 AND y.i + y.d <= length(y.strand)"""


@query("conditional_unpaired", f"WITH RECURSIVE {S.RUNS}, {S.folds(_STRANDS)}, {S.joint(_TWO_WINDOWS)} SELECT strand, i, j, k, l, round(p / p1, 8) AS p FROM joint", 8)
def conditional_unpaired(spark, sf):
    return hybrid.conditional_probabilities(B.runs(spark, sf), most=4, least=3, distance=2)


_MODEL_SITES = f"""{S.folds("SELECT seq_a AS strand FROM runs UNION SELECT reverse(seq_b) FROM runs")},
{S.windows(8)},
span_a AS (SELECT run_id, i, j, p FROM runs JOIN unpaired ON strand = seq_a),
span_b AS (SELECT run_id, length(seq_b) - j + 1 AS i, length(seq_b) - i + 1 AS j, p FROM runs JOIN unpaired ON strand = reverse(seq_b)),
sites AS MATERIALIZED (
  SELECT * FROM (
    SELECT h.run_id, h.i1, h.i2, h.j1, h.j2, CAST(round(-100 * {S.RT!r} * ln(q)) AS BIGINT) AS hybrid,
           CAST(round(-100 * {S.RT!r} * ln(q)) + round(-100 * {S.RT!r} * ln(a.p) - 100 * {S.RT!r} * ln(b.p)) AS BIGINT) AS energy
    FROM hybrid h JOIN span_a a ON a.run_id = h.run_id AND a.i = h.i1 AND a.j = h.j1 JOIN span_b b ON b.run_id = h.run_id AND b.i = h.i2 AND b.j = h.j2
    WHERE h.j1 - h.i1 >= 2 AND h.j2 - h.i2 >= 2 AND abs((h.j1 - h.i1) - (h.j2 - h.i2)) <= 3)
  WHERE hybrid <= 700 AND energy <= 1200)"""


def _model_sites(r):
    return r, landscape.enumerate_sites(r, energies=landscape.model_energies(r))


@runs_query("state_energy_model", f"{_PATHS}, {_MODEL_SITES} SELECT * FROM sites")
def state_energy_model(r):
    return _model_sites(r)[1]


@runs_query("gradient_basins_model", f"{_PATHS}, {_MODEL_SITES}{S.BASINS.replace(S.SITES, '')} SELECT * FROM members")
def gradient_basins_model(r):
    sites = checkpointed(_model_sites(r)[1])  # ranges of ranks are found from a sample, for which they would be made twice
    ranked = checkpointed(landscape.rank_states(landscape.with_open_state(r, sites)))
    return landscape.basin_members(landscape.resolve_parents(landscape.gradient_parents(ranked, landscape.moves(ranked))))


# moves and basins

_MOVE = "SELECT run_id, src, dst, CAST(kind AS BIGINT) AS kind, e_src, e_dst, CAST(e_ts AS BIGINT) AS e_ts FROM"


@runs_query("moves_grow_shrink", f"WITH {S.RANKED} {_MOVE} ({S.GROW})")
def moves_grow_shrink(r):
    return landscape.grow_shrink_moves(_ranked(r))


@runs_query("moves_shift", f"WITH {S.RANKED}, m(run_id, src, dst, kind, e_src, e_dst, e_ts) AS ({S.SHIFT}) {_MOVE} m")
def moves_shift(r):
    return landscape.shift_moves(_ranked(r))


@runs_query("moves_open_close", f"WITH {S.RANKED} {_MOVE} ({S.OPEN_CLOSE})")
def moves_open_close(r):
    return landscape.open_close_moves(_ranked(r))


@runs_query("moves_merge_split", f"""WITH {S.SITES} SELECT x.run_id, x.i1, x.i2, x.j1, x.j2, y.i1 AS k1, y.i2 AS k2, y.j1 AS l1, y.j2 AS l2, m.energy AS merged_energy
FROM sites x JOIN sites y ON x.run_id = y.run_id AND y.i1 = x.j1 + 1 AND y.i2 = x.j2 + 1
JOIN sites m ON m.run_id = x.run_id AND m.i1 = x.i1 AND m.i2 = x.i2 AND m.j1 = y.j1 AND m.j2 = y.j2""")  # fmt: skip
def moves_merge_split(r):
    sites, near = _sites(r), landscape.SiteLimits(distance=0)
    return landscape.merge_split_moves(landscape.enumerate_double_sites(sites, near), sites, near)


@runs_query("movable_states", f"WITH {S.EDGES} SELECT run_id, rank FROM ranked r WHERE i1 IS NULL OR EXISTS (SELECT 1 FROM edges e WHERE e.run_id = r.run_id AND e.src = r.rank)")
def movable_states(r):
    ranked = _ranked(r)
    return landscape.without_frozen(ranked, landscape.moves(ranked)).select("run_id", "rank")


@runs_query("basin_track", f"WITH {{}} SELECT run_id, basin, string_agg(rank, chr(9) ORDER BY rank) AS track FROM members GROUP BY run_id, basin".format(S.BASINS.replace("runs AS (", "RECURSIVE runs AS (", 1)))
def basin_track(r):
    return exports.basin_track(_basins(r)[2])


@runs_query("gradient_parent", f"WITH {S.PARENTS} SELECT * FROM parents")
def gradient_parent(r):
    ranked = _ranked(r)
    return landscape.gradient_parents(ranked, landscape.moves(ranked))


def _basins(r):
    ranked = _ranked(r)
    edges = checkpointed(landscape.moves(ranked))
    members = checkpointed(landscape.basin_members(landscape.resolve_parents(landscape.gradient_parents(ranked, edges))))
    return ranked, edges, members


_RECURSIVE = S.BASINS.replace("runs AS (", "RECURSIVE runs AS (", 1)
_SUMMARY = S.SUMMARY.replace("runs AS (", "RECURSIVE runs AS (", 1)


@runs_query("gradient_basins", f"WITH {_RECURSIVE} SELECT * FROM members")
def gradient_basins(r):
    return _basins(r)[2]


@runs_query("basin_summary", f"WITH {_SUMMARY} SELECT run_id, basin, n_states, round(-{S.RT!r} * ln(z), 6) AS free_energy, min_energy, min_rank FROM summary", 6)
def basin_summary(r):
    ranked, _, members = _basins(r)
    return landscape.basin_summary(ranked, members).select("run_id", "basin", "n_states", energy.free_energy(F.col("z")).alias("free_energy"), "min_energy", "min_rank")


@runs_query("basin_equilibrium", f"WITH {_SUMMARY} SELECT run_id, basin, n_states, round(z / sum(z) OVER (PARTITION BY run_id), 8) AS p FROM summary")
def basin_equilibrium(r):
    ranked, _, members = _basins(r)
    summary = landscape.basin_summary(ranked, members)
    return ctmc.stationary(summary.select("run_id", F.col("basin").alias("b"), "z")).withColumnRenamed("b", "basin").join(summary.select("run_id", "basin", "n_states"), ["run_id", "basin"])


@runs_query("basin_transitions", f"""WITH {_RECURSIVE} SELECT e.run_id, least(s.basin, t.basin) AS a, greatest(s.basin, t.basin) AS b,
  round(-{S.RT!r} * ln(sum(exp(-greatest(e_src, e_dst, e_ts) / 100.0 / {S.RT!r}))), 6) AS barrier
FROM edges e JOIN members s ON e.run_id = s.run_id AND e.src = s.rank JOIN members t ON e.run_id = t.run_id AND e.dst = t.rank
WHERE dst < src AND s.basin <> t.basin GROUP BY ALL""", 6)  # fmt: skip
def basin_transitions(r):
    _, edges, members = _basins(r)
    return landscape.basin_transitions(edges, members).select("run_id", "a", "b", energy.free_energy(F.col("z")).alias("barrier"))


@runs_query("basin_kinetics", None, 6)
def basin_kinetics(r):
    ranked, edges, members = _basins(r)
    nodes = landscape.basin_summary(ranked, members).select("run_id", F.col("basin").alias("b"), "z")
    weights = landscape.basin_transitions(edges, members).withColumnRenamed("z", "w")
    return ctmc.solve(nodes, weights, ctmc.SolveSpec(tolerance=5e-3))


_DOUBLE = f"""{S.SITES},
double AS (
  SELECT x.run_id, x.i1, x.i2, x.j1, x.j2, y.i1 AS k1, y.i2 AS k2, y.j1 AS l1, y.j2 AS l2, x.hybrid + y.hybrid AS hybrid,
         x.energy - x.hybrid + y.energy - y.hybrid AS unpaired, x.energy + y.energy AS energy, x.hybrid AS h1, y.hybrid AS h2
  FROM sites x JOIN sites y ON x.run_id = y.run_id AND y.i1 >= x.j1 + 1 AND y.i2 >= x.j2 + 1)"""
_NEAR = landscape.SiteLimits(distance=0)
_BOTH = "run_id, i1, i2, j1, j2, k1, k2, l1, l2"


@runs_query("double_state_energy", f"WITH {_DOUBLE} SELECT {_BOTH}, hybrid, unpaired, energy FROM double")
def double_state_energy(r):
    return landscape.double_states(_sites(r), _NEAR).drop("h1", "h2")


@runs_query("moves_double_left", f"""WITH {_DOUBLE} SELECT s.run_id, s.i1, s.i2, s.j1, s.j2, s.l1, s.l2, s.k1 AS s_k1, s.k2 AS s_k2, t.k1 AS t_k1, t.k2 AS t_k2,
  CAST(CASE WHEN t.k1 > s.k1 THEN t.hybrid + s.unpaired ELSE s.hybrid + t.unpaired END + {S._LOOP.format("(t.k1 - s.k1)", "(t.k2 - s.k2)")} AS BIGINT) AS e_ts
FROM double s JOIN double t ON s.run_id = t.run_id AND s.i1 = t.i1 AND s.i2 = t.i2 AND s.j1 = t.j1 AND s.j2 = t.j2 AND s.l1 = t.l1 AND s.l2 = t.l2
WHERE (t.k1 - s.k1) * (t.k2 - s.k2) > 0 AND abs(t.k1 - s.k1) <= 7 AND abs(t.k2 - s.k2) <= 7""")  # fmt: skip
def moves_double_left(r):
    return landscape.grow_shrink_double(landscape.double_states(_sites(r), _NEAR), second=True, left=True)


@runs_query("moves_double_right", f"""WITH {_DOUBLE} SELECT s.run_id, s.i1, s.i2, s.k1, s.k2, s.l1, s.l2, s.j1 AS s_j1, s.j2 AS s_j2, t.j1 AS t_j1, t.j2 AS t_j2,
  CAST(CASE WHEN t.j1 < s.j1 THEN t.hybrid + s.unpaired ELSE s.hybrid + t.unpaired END + {S._LOOP.format("(t.j1 - s.j1)", "(t.j2 - s.j2)")} AS BIGINT) AS e_ts
FROM double s JOIN double t ON s.run_id = t.run_id AND s.i1 = t.i1 AND s.i2 = t.i2 AND s.k1 = t.k1 AND s.k2 = t.k2 AND s.l1 = t.l1 AND s.l2 = t.l2
WHERE (t.j1 - s.j1) * (t.j2 - s.j2) > 0 AND abs(t.j1 - s.j1) <= 7 AND abs(t.j2 - s.j2) <= 7""")  # fmt: skip
def moves_double_right(r):
    return landscape.grow_shrink_double(landscape.double_states(_sites(r), _NEAR), second=False, left=False)


@runs_query("moves_new_site", f"""WITH {_DOUBLE} SELECT 'left' AS side, {_BOTH}, CAST(unpaired + h2 + {S._LOOP.format("(j1 - i1)", "(j2 - i2)")} AS BIGINT) AS e_ts FROM double WHERE j1 - i1 <= 7 AND j2 - i2 <= 7
UNION ALL SELECT 'right', {_BOTH}, CAST(unpaired + h1 + {S._LOOP.format("(l1 - k1)", "(l2 - k2)")} AS BIGINT) FROM double WHERE l1 - k1 <= 7 AND l2 - k2 <= 7""")  # fmt: skip
def moves_new_site(r):
    double = landscape.double_states(_sites(r), _NEAR)
    sides = [landscape.new_site_moves(double, left).withColumn("side", F.lit(name)) for name, left in (("left", True), ("right", False))]
    return sides[0].unionByName(sides[1])


@runs_query("merge_split_saddles", f"""WITH {_DOUBLE} SELECT d.run_id, d.i1, d.i2, d.j1, d.j2, k1, k2, l1, l2, m.energy AS merged_energy, CAST(m.energy - m.hybrid + d.hybrid AS BIGINT) AS e_ts
FROM double d JOIN sites m ON m.run_id = d.run_id AND m.i1 = d.i1 AND m.i2 = d.i2 AND m.j1 = d.l1 AND m.j2 = d.l2 WHERE k1 = d.j1 + 1 AND k2 = d.j2 + 1""")  # fmt: skip
def merge_split_saddles(r):
    sites = _sites(r)
    return landscape.merge_split_saddles(landscape.double_states(sites, _NEAR), sites, _NEAR)


@runs_query("distinct_regions", f"WITH {S.SITES} SELECT DISTINCT run_id, 'a' AS strand, i1 AS i, j1 AS j FROM sites UNION SELECT run_id, 'b', i2, j2 FROM sites")
def distinct_regions(r):
    return landscape.distinct_regions(_sites(r))


@query("region_pair_probabilities", f"""WITH RECURSIVE {S.SITES}, {S.folds("SELECT DISTINCT seq_a AS strand FROM runs")},
held AS (SELECT DISTINCT seq_a AS strand, i1 AS i, j1 AS j FROM sites JOIN runs USING (run_id)),
free AS (
  SELECT h.strand, h.i, h.j, pairs, w, sum(w) OVER (PARTITION BY h.strand, h.i, h.j) AS total
  FROM held h JOIN fold f ON f.strand = h.strand AND paired & (((1::BIGINT << CAST(h.j - h.i + 1 AS INT)) - 1) << CAST(h.i AS INT)) = 0)
SELECT strand, i, j, p.k AS k, p.l AS l, round(sum(w / total), 6) AS p FROM (SELECT *, unnest(pairs) AS p FROM free) GROUP BY ALL""", 6)  # fmt: skip
def region_pair_probabilities(spark, sf):
    r = B.runs(spark, sf)
    regions = landscape.distinct_regions(_sites(B.runs(spark, sf))).where("strand = 'a'").join(r, "run_id")
    return hybrid.region_pair_probabilities(regions.select(F.col("seq_a").alias("strand"), "i", "j"))


@runs_query("basin_pair_weights", f"""{_PATHS.replace("hybrid AS (", S.SITES.replace(S.GRID + ",", "").lstrip() + "," + S.BASINS.replace(S.SITES + ",", "") + ", hybrid AS (", 1)}
SELECT m.run_id, basin, l.j1 AS k1, l.j2 AS k2, round(-{S.RT!r} * ln(sum(exp(-r.energy / 100.0 / {S.RT!r}) * l.q * h.q / w.q)), 6) AS energy
FROM members m JOIN ranked r ON m.run_id = r.run_id AND m.rank = r.rank
JOIN hybrid w ON w.run_id = r.run_id AND w.i1 = r.i1 AND w.i2 = r.i2 AND w.j1 = r.j1 AND w.j2 = r.j2
JOIN hybrid l ON l.run_id = r.run_id AND l.i1 = r.i1 AND l.i2 = r.i2
JOIN hybrid h ON h.run_id = r.run_id AND h.i1 = l.j1 AND h.i2 = l.j2 AND h.j1 = r.j1 AND h.j2 = r.j2
GROUP BY m.run_id, basin, l.j1, l.j2""", 6)  # fmt: skip
def basin_pair_weights(r):
    ranked, _, members = _basins(r)
    states = members.join(ranked.where("i1 is not null"), ["run_id", "rank"]).select("run_id", "basin", *SITE, energy.boltzmann(F.col("energy") / 100.0).alias("z"))
    weights = hybrid.basin_pair_weights(states, checkpointed(_hybrid(r)))
    return weights.select("run_id", "basin", "k1", "k2", energy.free_energy(F.col("w")).alias("energy"))


_MATTER = f"""WITH {_SUMMARY}, {S.folds("SELECT seq_a AS strand FROM runs UNION SELECT reverse(seq_b) FROM runs")},
share AS (SELECT run_id, basin, z, z / sum(z) OVER (PARTITION BY run_id) AS p FROM summary),
matter AS (  -- states of one basin or more that hold a hundredth
  SELECT r.*, s.basin, seq_a, reverse(seq_b) AS seq_r, length(seq_b) AS n, exp(-r.energy / 100.0 / {S.RT!r}) / s.z AS part
  FROM share s JOIN members m ON m.run_id = s.run_id AND m.basin = s.basin JOIN ranked r ON r.run_id = m.run_id AND r.rank = m.rank JOIN runs ON runs.run_id = s.run_id
  WHERE s.p >= 0.01 AND exp(-r.energy / 100.0 / {S.RT!r}) / s.z * s.p >= 0.01),
held AS (
  SELECT run_id, basin, rank, part, 'a' AS strand, seq_a AS letters, coalesce(i1, 1) AS i, coalesce(j1, 0) AS j FROM matter
  UNION ALL SELECT run_id, basin, rank, part, 'b', seq_r, coalesce(n - j2 + 1, 1), coalesce(n - i2 + 1, 0) FROM matter),
open_folds AS (
  SELECT h.letters, h.i, h.j, pairs, w / sum(w) OVER (PARTITION BY h.letters, h.i, h.j) AS p
  FROM (SELECT DISTINCT letters, i, j FROM held) h JOIN fold f ON f.strand = h.letters AND paired & (((1::BIGINT << CAST(h.j - h.i + 1 AS INT)) - 1) << CAST(h.i AS INT)) = 0),
event AS (SELECT letters, i, j, q.k AS k, q.l AS l, sum(p) AS p FROM (SELECT *, unnest(pairs) AS q FROM open_folds) GROUP BY ALL HAVING sum(p) >= 0.01)"""


def _basin_events(r, ranked, members):
    """Equilibrium shares and the events of the states that matter by them, cut as ``_MATTER`` cuts."""
    summary = checkpointed(landscape.basin_summary(ranked, members))
    most = ctmc.stationary(summary.select("run_id", F.col("basin").alias("b"), "z"))
    alone = summary.select("run_id", F.col("basin").alias("coarse"), F.col("basin").alias("fine"), F.lit(1.0).alias("part"))
    matter = events.relevant_states(most, alone, summary, members, ranked)
    own = events.pair_events(ranked.join(matter.select("run_id", "rank"), ["run_id", "rank"]), r)
    return most, events.basin_events(own, members, ranked)


@runs_query("basin_events", f"{_MATTER} SELECT run_id, basin, h.strand, e.k AS i, e.l AS j, round(sum(part * e.p), 6) AS p FROM held h JOIN event e ON e.letters = h.letters AND e.i = h.i AND e.j = h.j GROUP BY ALL", 6)
def basin_events(r):
    ranked, _, members = _basins(r)
    return _basin_events(r, ranked, members)[1]


@runs_query("paired_at_equilibrium", f"""{_MATTER}
SELECT h.run_id, h.strand, e.k AS i, e.l AS j, round(sum(s.p * part * e.p), 6) AS p FROM held h JOIN share s ON s.run_id = h.run_id AND s.basin = h.basin JOIN event e ON e.letters = h.letters AND e.i = h.i AND e.j = h.j GROUP BY ALL""", 6)  # fmt: skip
def paired_at_equilibrium(r):
    ranked, _, members = _basins(r)
    most, found = _basin_events(r, ranked, members)
    return events.paired_over_time(most.withColumn("t", F.lit(0.0)), found.withColumnRenamed("basin", "b")).drop("t")


@runs_query("paired_over_time", None, 6)
def paired_over_time(r):
    ranked, edges, members = _basins(r)
    summary = checkpointed(landscape.basin_summary(ranked, members))
    found = events.whole_basin_events(summary, members, ranked, r).withColumnRenamed("basin", "b")  # a basin of no weight at equilibrium may hold much on the way there
    weights = landscape.basin_transitions(edges, members).withColumnRenamed("z", "w")
    return ctmc.solve_events(summary.select("run_id", F.col("basin").alias("b"), "z"), weights, found, ctmc.SolveSpec(end=1e5))


# states of up to two sites


def _two_site_states(r):
    sites = checkpointed(landscape.enumerate_sites(r))
    return checkpointed(two_sites.states(r, sites, two_sites.double_states(sites)))


def _two_sites(r):
    """Ranked states and moves, at least six bases between two sites."""
    ranked = _two_site_states(r)
    return ranked, two_sites.moves(ranked, two_sites.sites_between(r))


@runs_query("two_site_states", f"WITH {S.TWO_STATES} SELECT run_id, rank, {', '.join(f'coalesce({c}, 0) AS {c}' for c in (*SITE, *landscape.SECOND))}, hybrid, energy FROM ranked", runs=B.long_runs)
def two_site_states(r):
    ranked = _two_site_states(r)
    return ranked.select("run_id", "rank", *[F.coalesce(c, F.lit(0)).alias(c) for c in (*SITE, *landscape.SECOND)], "hybrid", "energy")


@runs_query("two_site_moves", f"WITH {S.TWO_EDGES} SELECT run_id, src, dst, CAST(kind AS BIGINT) AS kind, e_src, e_dst, e_ts FROM edges", runs=B.long_runs)
def two_site_moves(r):
    return _two_sites(r)[1]


@runs_query("two_site_basins", f"WITH RECURSIVE {S.TWO_BASINS} SELECT * FROM members", runs=B.long_runs)
def two_site_basins(r):
    ranked, moves = _two_sites(r)
    return landscape.basin_members(landscape.resolve_parents(landscape.gradient_parents(ranked, moves)))


_LONG_PAIRS = """pair AS (
  SELECT x.run_id, x.i1, x.i2, x.j1, x.j2, y.i1 AS k1, y.i2 AS k2, y.j1 AS l1, y.j2 AS l2, x.hybrid + y.hybrid AS hybrid, seq_a, reverse(seq_b) AS seq_r, length(seq_b) + 1 AS n
  FROM sites x JOIN sites y ON x.run_id = y.run_id AND y.i1 >= x.j1 + 7 AND y.i2 >= x.j2 + 7 JOIN runs r ON r.run_id = x.run_id)"""
_LONG_JOINT = S.joint("SELECT seq_a AS strand, i1 AS i, j1 AS j, k1 AS k, l1 AS l FROM pair UNION SELECT seq_r, n - l2, n - k2, n - j2, n - i2 FROM pair")


@runs_query("two_site_energy_model", f"""{_PATHS.replace(S.RUNS, S.LONG_RUNS)}, {_MODEL_SITES}, {_LONG_PAIRS}, {_LONG_JOINT}
SELECT * FROM (
  SELECT run_id, i1, i2, j1, j2, k1, k2, l1, l2, hybrid, CAST(hybrid + round(-100 * {S.RT!r} * ln(a.p) - 100 * {S.RT!r} * ln(b.p)) AS BIGINT) AS energy
  FROM pair p JOIN joint a ON a.strand = seq_a AND a.i = i1 AND a.j = j1 AND a.k = k1 AND a.l = l1
  JOIN joint b ON b.strand = seq_r AND b.i = n - l2 AND b.j = n - k2 AND b.k = n - j2 AND b.l = n - i2) WHERE energy <= 1200""", runs=B.long_runs)  # fmt: skip
def two_site_energy_model(r):
    limits = landscape.SiteLimits()
    sites = checkpointed(landscape.enumerate_sites(r, limits, landscape.model_energies(r, limits)))
    joint = two_sites.JointUnpaired(*hybrid.joint_windows(r, limits.most, limits.least, limits.distance))
    return two_sites.double_states(sites, limits, joint).drop("h1", "h2")


@runs_query("basin_pair_probs", f"""{_PATHS.replace("hybrid AS (", S.SITES.replace(S.GRID + ",", "").lstrip() + "," + S.SUMMARY.replace(S.SITES + ",", "") + ", hybrid AS (", 1)}
SELECT run_id, basin, k1, k2, round(round(p / 0.01) * 0.01, 6) AS p FROM (
  SELECT m.run_id, m.basin, l.j1 AS k1, l.j2 AS k2, sum(exp(-r.energy / 100.0 / {S.RT!r}) * l.q * h.q / w.q) / any_value(s.z) AS p
  FROM members m JOIN ranked r ON m.run_id = r.run_id AND m.rank = r.rank JOIN summary s ON s.run_id = m.run_id AND s.basin = m.basin
  JOIN hybrid w ON w.run_id = r.run_id AND w.i1 = r.i1 AND w.i2 = r.i2 AND w.j1 = r.j1 AND w.j2 = r.j2
  JOIN hybrid l ON l.run_id = r.run_id AND l.i1 = r.i1 AND l.i2 = r.i2
  JOIN hybrid h ON h.run_id = r.run_id AND h.i1 = l.j1 AND h.i2 = l.j2 AND h.j1 = r.j1 AND h.j2 = r.j2
  GROUP BY m.run_id, m.basin, l.j1, l.j2) WHERE p > 0.01""", 6)  # fmt: skip
def basin_pair_probs(r):
    ranked, _, members = _basins(r)
    states = members.join(ranked.where("i1 is not null"), ["run_id", "rank"]).select("run_id", "basin", *SITE, energy.boltzmann(F.col("energy") / 100.0).alias("z"))
    weights = hybrid.basin_pair_weights(states, checkpointed(_hybrid(r)))
    total = landscape.basin_summary(ranked, members).select("run_id", "basin", "z")
    return exports.quantised(weights.join(total, ["run_id", "basin"]).select("run_id", "basin", "k1", "k2", (F.col("w") / F.col("z")).alias("p")), 0.01)


@runs_query("basin_track_lines", f"""WITH {_SUMMARY}, x AS (
  SELECT m.run_id, m.basin, m.rank, energy, CASE WHEN i1 IS NULL THEN '{{}}' ELSE '{{(' || i1 || ',' || i2 || ')-(' || j1 || ',' || j2 || ')}}' END AS s FROM members m JOIN ranked r ON r.run_id = m.run_id AND r.rank = m.rank)
SELECT x.run_id, x.basin, concat_ws(chr(9), x.basin, any_value(n_states), printf('%.6g', round(-{S.RT!r} * ln(any_value(z)), 9) + 0.0), arg_min(s, (energy, x.rank)), printf('%.6g', min(energy) / 100.0), string_agg(s, ' ' ORDER BY x.rank)) AS line
FROM x JOIN summary y ON y.run_id = x.run_id AND y.basin = x.basin GROUP BY x.run_id, x.basin""")  # fmt: skip
def basin_track_lines(r):
    ranked, _, members = _basins(r)
    return exports.basin_track_lines(ranked, members, landscape.basin_summary(ranked, members))


@query("input_errors", f"""WITH {S.RANKED},
read AS (
  SELECT run_id, rank AS line, i1, i2, CASE WHEN rank % 13 = 4 THEN i1 + 1 ELSE j1 END AS j1, j2, energy / 100.0 + CASE WHEN rank % 11 = 5 THEN 2.0 ELSE 0 END AS e FROM ranked WHERE i1 IS NOT NULL),
b AS (SELECT r.*, lag(e) OVER (PARTITION BY r.run_id ORDER BY line) AS before, length(seq_a) AS n, length(seq_b) AS m FROM read r JOIN runs ON runs.run_id = r.run_id)
SELECT run_id, line, 'invalid' AS error, NULL::DOUBLE AS value FROM b WHERE NOT (j1 <= n AND j2 <= m AND j1 - i1 >= 2 AND j2 - i2 >= 2)
UNION ALL SELECT run_id, line, 'unsorted', round(before, 8) FROM b WHERE e + 1e-6 < before
UNION ALL SELECT run_id, line, 'outside', NULL FROM b WHERE i1 < 2 OR j1 > 15 OR i2 < 1 OR j2 > 9""")  # fmt: skip
def input_errors(spark, sf):
    r, line = B.runs(spark, sf), F.col("rank")
    read = _ranked(B.runs(spark, sf)).select("run_id", line.alias("line"), "i1", "i2", F.when(line % 13 == 4, F.col("i1") + 1).otherwise(F.col("j1")).alias("j1"), "j2", *[F.lit(None).cast("int").alias(c) for c in landscape.SECOND],
                                     (F.col("energy") / 100.0 + F.when(line % 11 == 5, 2.0).otherwise(0.0)).alias("energy"))
    return checks.input_errors(read, r, regions=((2, 15), (1, 9)))


# graphs


def _trade(spark, sf):
    nodes, edges = B.trade_edges(spark, sf)
    return checkpointed(nodes), checkpointed(edges)


@query("outflow", f"WITH {S.TRADE} SELECT b, z, out_w, round(out_rate, 8) AS out_rate, round(max_rate, 8) AS max_rate FROM rates")
def outflow(spark, sf):
    return graph.outflow(*_trade(spark, sf))


@query("p_equ", f"WITH {S.TRADE} SELECT b, z, round(p, 8) AS p FROM shares")
def p_equ(spark, sf):
    return graph.equilibrium(_trade(spark, sf)[0])


@query("max_outflow_by_quantile", f"WITH {S.TRADE} SELECT round(out_rate, 8) AS threshold FROM (SELECT out_rate, row_number() OVER (ORDER BY out_rate) AS k, count(*) OVER () AS n FROM rates) WHERE k = trunc(90 * (n - 1) / 100.0) + 1")
def max_outflow_by_quantile(spark, sf):
    return graph.max_outflow_by_quantile(graph.outflow(*_trade(spark, sf)), 90)


@query("min_pequ_by_number", f"WITH {S.TRADE} SELECT round(p, 8) AS threshold FROM (SELECT p, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS n FROM shares) WHERE k = n - 5 + 1")
def min_pequ_by_number(spark, sf):
    return graph.min_equilibrium_by_number(graph.equilibrium(_trade(spark, sf)[0]), 5)


@query("max_outflow_by_number", f"WITH {S.TRADE} SELECT round(out_rate, 8) AS threshold FROM (SELECT out_rate, row_number() OVER (ORDER BY out_rate) AS k FROM rates) WHERE k = 7")
def max_outflow_by_number(spark, sf):
    return graph.max_outflow_by_number(graph.outflow(*_trade(spark, sf)), 7)


@query("min_pequ_by_quantile", f"WITH {S.TRADE} SELECT round(p, 8) AS threshold FROM (SELECT p, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS n FROM shares) WHERE k = trunc(n - 30 * n / 100.0) + 1")
def min_pequ_by_quantile(spark, sf):
    return graph.min_equilibrium_by_quantile(graph.equilibrium(_trade(spark, sf)[0]), 30)


@query("run_limits", f"""WITH {S.TRADE_RUNS}, r AS (SELECT n.run_id, n.z / sum(n.z) OVER (PARTITION BY n.run_id) AS p, coalesce(o / n.z, 0) AS rate, count(*) OVER (PARTITION BY n.run_id) AS n
  FROM rnodes n LEFT JOIN (SELECT run_id, s, sum(w) AS o FROM rends GROUP BY ALL) f ON n.run_id = f.run_id AND n.b = f.s),
k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY rate) AS kr, row_number() OVER (PARTITION BY run_id ORDER BY p) AS kp FROM r)
SELECT run_id, round(least(max(rate) FILTER (WHERE kr = 20), max(rate) FILTER (WHERE kr = trunc(90 * (n - 1) / 100.0) + 1)), 8) AS max_outflow,
       round(greatest(max(p) FILTER (WHERE kp = n - 20 + 1), max(p) FILTER (WHERE kp = trunc(n - 70 * n / 100.0) + 1)), 8) AS min_share FROM k GROUP BY run_id""")  # fmt: skip
def run_limits(spark, sf):
    return graph.run_limits(*_trade_runs(spark, sf), 20, 90, 20, 70)


@query("stats_ladder", f"""WITH {S.TRADE}, o AS (SELECT out_rate, row_number() OVER (ORDER BY out_rate) AS k, count(*) OVER () AS n FROM rates),
s AS (SELECT p, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS n FROM shares)
SELECT o.k AS n, round(out_rate, 8) AS max_outflow, round(p, 8) AS min_p FROM o JOIN s ON s.k = s.n - o.k + 1 WHERE o.k > 1 AND list_contains(list_transform(range(0, 20), lambda x: o.n >> CAST(x AS INT)), o.k)""")  # fmt: skip
def stats_ladder(spark, sf):
    nodes, edges = _trade(spark, sf)
    return exports.stats_ladder(graph.outflow(nodes, edges), graph.equilibrium(nodes))


@query("graph_stats", f"WITH {S.TRADE} SELECT (SELECT count(*) FROM nodes) AS basins, (SELECT count(*) FROM ends) AS transitions, round((SELECT avg(out_rate) FROM rates), 8) AS mean_outflow, round((SELECT max(max_rate) FROM rates), 8) AS max_rate")
def graph_stats(spark, sf):
    nodes, edges = _trade(spark, sf)
    return exports.graph_stats(graph.outflow(nodes, edges), edges)


@query("min_rate_filter", f"WITH {S.TRADE} SELECT e.a, e.b, w FROM edges e JOIN nodes x ON e.a = x.b JOIN nodes y ON e.b = y.b WHERE w / least(x.z, y.z) >= 0.04")
def min_rate_filter(spark, sf):
    return graph.filter_by_rate(*_trade(spark, sf), 0.04)


@query("merge_candidates", f"WITH {S.TRADE} SELECT r.b, round(out_rate, 8) AS out_rate, round(p, 8) AS p FROM rates r JOIN shares s ON r.b = s.b WHERE r.b <> 0 AND (p < 0.039 OR out_rate > 0.97)")
def merge_candidates(spark, sf):
    nodes, edges = _trade(spark, sf)
    return graph.merge_candidates(graph.outflow(nodes, edges), graph.equilibrium(nodes), 0.97, 0.039)


@query("association_prefactor", f"WITH {S.TRADE} SELECT a, b, CASE WHEN a = 0 OR b = 0 THEN w * 2.5 ELSE w END AS w FROM edges")
def association_prefactor(spark, sf):
    return graph.with_prefactor(_trade(spark, sf)[1], 0, 2.5)


def _trade_runs(spark, sf):
    nodes, edges = B.trade_runs(spark, sf)
    return checkpointed(nodes), checkpointed(edges)


_DISSOLVED = f"""WITH {S.TRADE},
out3 AS (SELECT t AS b, w AS g, w / sum(w) OVER () AS f FROM ends WHERE s = 3),
one AS (SELECT n.b, n.z + coalesce(f, 0) * (SELECT z FROM nodes WHERE b = 3) AS z FROM nodes n LEFT JOIN out3 USING (b) WHERE n.b <> 3),
links AS (  -- both directions of a pair, and a basin with itself once
  SELECT s, t, sum(w) AS w FROM (
    SELECT s, t, w FROM ends WHERE s <> 3 AND t <> 3
    UNION ALL SELECT x.b, y.b, x.g * y.f + y.g * x.f FROM out3 x CROSS JOIN out3 y) GROUP BY s, t),
own AS (SELECT coalesce(sum(w), 0) AS w FROM links WHERE s = 7 AND t = 7),
out7 AS (SELECT t AS b, w AS g, w / sum(w) OVER () AS f FROM links WHERE s = 7 AND t <> 7)"""


@query("dissolve_nodes", f"{_DISSOLVED} SELECT o.b, round(o.z + coalesce(f, 0) * (SELECT z FROM one WHERE b = 7), 6) AS z FROM one o LEFT JOIN out7 USING (b) WHERE o.b <> 7", 6)
def dissolve_nodes(spark, sf):
    return graph.dissolve(*graph.dissolve(*_trade(spark, sf), 3), 7)[0]


@query("dissolve_edges", f"""{_DISSOLVED} SELECT s AS a, t AS b, round(sum(w), 6) AS w FROM (
  SELECT s, t, w FROM links WHERE s <> 7 AND t <> 7
  UNION ALL SELECT x.b, y.b, x.g * y.f + y.g * x.f + (SELECT w FROM own) * x.f * y.f FROM out7 x CROSS JOIN out7 y) WHERE s <= t GROUP BY s, t""", 6)  # fmt: skip
def dissolve_edges(spark, sf):
    return graph.dissolve(*graph.dissolve(*_trade(spark, sf), 3), 7)[1]


_RARE = graph.PruneLimits(min_share=0.041)


def _without_parts(pruned: DataFrame) -> DataFrame:
    return pruned.where("kind <> 'part'").select("run_id", "kind", "a", "b", "value")


@query("prune_graph", f"WITH RECURSIVE {S.PRUNED} {S.LEFT}", 6)
def prune_graph(spark, sf):
    return _without_parts(graph.prune(*_trade_runs(spark, sf), _RARE))


@query("prune_by_flow", f"WITH RECURSIVE {S.PRUNED_BY_FLOW} {S.LEFT}", 6)
def prune_by_flow(spark, sf):
    return _without_parts(graph.prune(*_trade_runs(spark, sf), graph.PruneLimits(max_outflow=0.95, min_share=0.02, min_rate=0.05)))


@query("prune_in_rounds", f"WITH RECURSIVE {S.PRUNED_SPARSE}, {S.PARTS} SELECT * FROM ({S.LEFT}) UNION ALL SELECT run_id, 'part', final, basin, round(part, 6) FROM parts", 6)
def prune_in_rounds(spark, sf):
    nodes, edges = _trade_runs(spark, sf)
    return graph.prune_in_rounds(nodes, graph.filter_by_rate(nodes, edges, S.SPARSE_RUNS), _RARE)


@query("prune_run", f"""WITH RECURSIVE {S.PRUNE_RUN} SELECT run_id, 'node' AS kind, b AS a, b, round(z, 6) AS value FROM named
UNION ALL SELECT run_id, CASE WHEN s = t THEN 'self' ELSE 'edge' END, s, t, round(w, 6) FROM links WHERE s <= t
UNION ALL SELECT x.run_id, 'edge', x.b, y.b, round(0.05 * least(x.z, y.z), 6) FROM heads x JOIN heads y ON x.run_id = y.run_id AND x.b < y.b""", 6)  # fmt: skip
def prune_run(spark, sf):
    nodes, edges = _trade_runs(spark, sf)
    steps = graph.PruneSteps(graph.PruneLimits(min_share=0.041, min_rate=0.05), prefactor=2.5)
    return _without_parts(graph.prune_run(nodes, graph.filter_by_rate(nodes, edges, S.SPARSE_RUNS), steps))


@query("prune_contributions", f"WITH RECURSIVE {S.PRUNED}, {S.PARTS} SELECT run_id, final, basin, round(part, 6) AS part FROM parts WHERE part >= 1e-3", 6)
def prune_contributions(spark, sf):
    pruned = graph.prune(*_trade_runs(spark, sf), _RARE)
    return pruned.where("kind = 'part' AND value >= 1e-3").select("run_id", F.col("a").alias("final"), F.col("b").alias("basin"), F.col("value").alias("part"))


@query("reduce_basins", f"WITH RECURSIVE {S.REDUCED} {S.LEFT}", 6)
def reduce_basins(spark, sf):
    return _without_parts(graph.prune(*_trade_runs(spark, sf), keep=S.KEEP))


@query("pruned_pair_probabilities", f"""WITH RECURSIVE {S.PRUNED}, {S.COARSE}, {S.PARTS}
SELECT p.run_id, final AS a, i, j, round(sum(part * n.z * ne.p) / any_value(p.z), 6) AS p FROM parts p JOIN rnodes n ON n.run_id = p.run_id AND n.b = p.basin JOIN ne ON ne.state = p.basin GROUP BY ALL""", 6)  # fmt: skip
def pruned_pair_probabilities(spark, sf):
    nodes, edges = _trade_runs(spark, sf)
    pruned = checkpointed(graph.prune(nodes, edges, _RARE))
    parts = pruned.where("kind = 'part'").select("run_id", "a", "b", F.col("value").alias("part"))
    final = pruned.where("kind = 'node'").select("run_id", "a", F.col("value").alias("z"))
    return graph.pruned_pair_probabilities(parts, nodes, B.nation_events(spark, sf).withColumnRenamed("state", "b"), final)


def _sparse(spark, sf):
    nodes, edges = _trade(spark, sf)
    return nodes, graph.filter_by_rate(nodes, edges, S.SPARSE)


_COMPONENTS = "WITH RECURSIVE " + S.COMPONENTS


@query("connected_components", f"{_COMPONENTS} SELECT * FROM components")
def connected_components(spark, sf):
    return graph.connected_components(*_sparse(spark, sf))


@query("component_sizes", f"{_COMPONENTS} SELECT component, count(*) AS basins, round(sum(z), 8) AS z FROM nodes JOIN components USING (b) GROUP BY component")
def component_sizes(spark, sf):
    nodes, edges = _sparse(spark, sf)
    return graph.component_sizes(nodes, graph.connected_components(nodes, edges))


@query("keep_component", f"{_COMPONENTS} SELECT n.b, n.z FROM nodes n JOIN components c ON n.b = c.b WHERE c.component = (SELECT component FROM components WHERE b = 1)")
def keep_component(spark, sf):
    nodes, edges = _sparse(spark, sf)
    return graph.keep_component(nodes, edges, graph.connected_components(nodes, edges), 1)[0]


@query("connect_components", f"""{_COMPONENTS},
heads AS (SELECT component, arg_max(n.b, (n.z, -n.b)) AS b, max(n.z) AS z FROM nodes n JOIN components c ON n.b = c.b GROUP BY component)
SELECT x.b AS a, y.b AS b, round(1e-3 * least(x.z, y.z), 8) AS w FROM heads x JOIN heads y ON x.b < y.b""")  # fmt: skip
def connect_components(spark, sf):
    nodes, edges = _sparse(spark, sf)
    return graph.connect_components(nodes, graph.connected_components(nodes, edges), 1e-3)


@query("reindex_basins", f"""WITH {S.TRADE}, kept AS (SELECT b, row_number() OVER (ORDER BY b) - 1 AS new FROM shares WHERE p >= 0.04)
SELECT x.new AS a, y.new AS b, w FROM edges e JOIN kept x ON e.a = x.b JOIN kept y ON e.b = y.b""")  # fmt: skip
def reindex_basins(spark, sf):
    nodes, edges = _trade(spark, sf)
    return graph.reindex(graph.equilibrium(nodes).where("p >= 0.04"), edges)[1]


@query("swap_basins", f"WITH {S.TRADE}, s AS (SELECT CASE WHEN a < 2 THEN 1 - a ELSE a END AS x, CASE WHEN b < 2 THEN 1 - b ELSE b END AS y, w FROM edges) SELECT least(x, y) AS a, greatest(x, y) AS b, w FROM s")
def swap_basins(spark, sf):
    return graph.swap_first_two(*_trade(spark, sf))[1]


# Markov chains


@query("symmetrize", f"WITH {S.CHAIN} SELECT * FROM sym")
def symmetrize(spark, sf):
    return ctmc.symmetrize(B.event_chain(spark, sf))


@query("rate_matrix", f"""WITH {S.TRADE}, r AS (SELECT s AS i, t AS j, w / z AS rate FROM ends JOIN nodes ON s = b)
SELECT i, j, round(rate, 8) AS rate FROM r UNION ALL SELECT i, i, round(-sum(rate), 8) FROM r GROUP BY i""")  # fmt: skip
def rate_matrix(spark, sf):
    return ctmc.rate_matrix(*_trade(spark, sf))


@query("symmetry_gap", f"""WITH {S.CHAIN}, code AS (SELECT i AS s, row_number() OVER (ORDER BY i) AS k FROM (SELECT DISTINCT i FROM sym)),
flow AS (SELECT x.k AS a, y.k AS b, v FROM chain JOIN code x ON i = x.s JOIN code y ON j = y.s WHERE i <> j),
pair AS (SELECT least(a, b) AS x, greatest(a, b) AS y, coalesce(sum(v) FILTER (WHERE a < b), 0) AS up, coalesce(sum(v) FILTER (WHERE a > b), 0) AS down FROM flow GROUP BY ALL)
SELECT round(max(abs(up - down)) / max(greatest(up, down)), 8) AS gap FROM pair""")  # fmt: skip
def symmetry_gap(spark, sf):
    chain = B.event_chain(spark, sf).withColumn("run_id", F.lit(0))
    nodes = chain.groupBy("run_id", F.col("i").alias("b")).agg(F.sum("v").alias("z"))
    return ctmc.symmetry_gap(nodes, chain.select("run_id", F.col("i").alias("a"), F.col("j").alias("b"), F.col("v").alias("w"))).select("gap")


@query("stationary_distribution", f"WITH {S.CHAIN} SELECT i AS state, round(sum(v) / (SELECT sum(v) FROM sym), 8) AS p FROM sym GROUP BY i")
def stationary_distribution(spark, sf):
    weight = ctmc.symmetrize(B.event_chain(spark, sf)).groupBy(F.col("i").alias("b")).agg(F.sum("v").alias("z"))
    return graph.equilibrium(weight).select(F.col("b").alias("state"), "p")


@query("time_grid", f"""WITH {S.TRADE_RUNS}, ends AS (SELECT run_id, sum(z) * 1e9 AS stop FROM rnodes GROUP BY run_id)
SELECT run_id, k, round(log10(0.1 * pow(1.2, k)), 8) AS log_t FROM ends, (SELECT unnest(range(0, 300)) AS k) WHERE 0.1 * pow(1.2, k) < stop""")  # fmt: skip
def time_grid(spark, sf):
    ends = B.trade_runs(spark, sf)[0].groupBy("run_id").agg((F.sum("z") * 1e9).alias("end"))
    return ctmc.run_time_grids(ends).select("run_id", "k", F.log10("t").alias("log_t"))


@query("solve_kinetics", f"WITH RECURSIVE {S.SOLVED} SELECT run_id, round(t, 8) AS t, b, round(p, 8) AS p FROM solved", 8)
def solve_kinetics(spark, sf):
    return ctmc.solve(*_trade_runs(spark, sf), ctmc.SolveSpec(t0=0.01, end=1e2))


_TIMES = (0.5, 1.0, 2.0, 4.0)


@query("propagate", f"""WITH RECURSIVE {S.SOLVED.replace("SELECT 0.01 * pow(1.2, k) AS t FROM (SELECT unnest(range(0, 64)) AS k) WHERE 0.01 * pow(1.2, k) < 1e2", f"SELECT CAST(unnest({list(_TIMES)}) AS DOUBLE) AS t")}
SELECT run_id, t, b, round(p, 8) AS p FROM solved""", 8)  # fmt: skip
def propagate(spark, sf):
    return ctmc.propagate(*_trade_runs(spark, sf), list(_TIMES))


@query("mfpt", f"WITH RECURSIVE {S.PASSAGE} SELECT run_id, a, b, round(time, 6) AS time FROM passage", 6)
def mfpt(spark, sf):
    return ctmc.passage_times(*_trade_runs(spark, sf))


@query("absorption_times", f"WITH RECURSIVE {S.PASSAGE} SELECT run_id, a, round(time, 6) AS time FROM passage WHERE b = 0", 6)
def absorption_times(spark, sf):
    return ctmc.passage_times(*_trade_runs(spark, sf), target=0).select("run_id", "a", "time")


@query("convergence_time", f"""WITH {S.KINETICS}, pi AS (SELECT state, avg(p) AS q FROM kin GROUP BY state),
gap AS (SELECT t, sum(abs(p - q)) AS gap FROM kin JOIN pi USING (state) GROUP BY t)
SELECT t, state, round(p, 8) AS p FROM kin WHERE t <= coalesce((SELECT min(t) FROM gap WHERE gap < 0.1), 1e9)""")  # fmt: skip
def convergence_time(spark, sf):
    kin = B.kinetics(spark, sf).withColumn("run_id", F.lit(0)).withColumnRenamed("state", "b")
    mean = kin.groupBy("run_id", "b").agg(F.avg("p").alias("p"))
    return ctmc.until_converged(kin, mean, 0.1).select("t", F.col("b").alias("state"), "p")


# analysis


@query("max_prob_over_time", f"WITH {S.KINETICS} SELECT state, round(max(p), 8) AS max_p FROM kin GROUP BY state HAVING max(p) >= 0.02")
def max_prob_over_time(spark, sf):
    return analysis.max_over_time(B.kinetics(spark, sf), 0.02)


@query("prominent_states", f"WITH {S.KINETICS} SELECT state FROM kin GROUP BY state HAVING max(p) >= 0.22")
def prominent_states(spark, sf):
    return analysis.prominent_states(B.kinetics(spark, sf), 0.22)


@query("event_prob_over_time", f"WITH {S.KINETICS} SELECT t, i, j, round(sum(kin.p * ev.p), 8) AS p FROM kin JOIN ev USING (state) GROUP BY t, i, j")
def event_prob_over_time(spark, sf):
    return analysis.event_probability(B.kinetics(spark, sf), B.events(spark, sf))


@query("positional_marginals", f"WITH {S.KINETICS} SELECT state, pos, round(sum(p), 8) AS p FROM (SELECT state, i AS pos, p FROM ev UNION ALL SELECT state, j, p FROM ev) GROUP BY state, pos")
def positional_marginals(spark, sf):
    return analysis.positional_marginals(B.events(spark, sf))


@query("positional_matrix", f"WITH {S.KINETICS} SELECT t, j AS pos, round(sum(kin.p * ev.p), 8) AS p FROM kin JOIN ev USING (state) GROUP BY t, j")
def positional_matrix(spark, sf):
    over_time = analysis.event_probability(B.kinetics(spark, sf), B.events(spark, sf))
    return over_time.groupBy("t", F.col("j").alias("pos")).agg(F.sum("p").alias("p"))


@query("dotplot_maxsp", f"WITH {S.KINETICS} SELECT i, j, round(sum(ev.p * m), 8) AS p FROM ev JOIN (SELECT state, max(p) AS m FROM kin GROUP BY state) USING (state) GROUP BY i, j")
def dotplot_maxsp(spark, sf):
    return analysis.dotplot_max_states(B.kinetics(spark, sf), B.events(spark, sf))


@query("dotplot_integrate", f"""WITH {S.KINETICS},
area AS (SELECT state, sum(a) / greatest(count(*) - 1, 1) AS m FROM (SELECT state, (p + lag(p) OVER (PARTITION BY state ORDER BY t)) / 2 AS a FROM kin) GROUP BY state)
SELECT i, j, round(sum(ev.p * coalesce(m, 0)), 8) AS p FROM ev JOIN area USING (state) GROUP BY i, j""")  # fmt: skip
def dotplot_integrate(spark, sf):
    return analysis.dotplot_integrated(B.kinetics(spark, sf), B.events(spark, sf))


@query("dotplot_maxbpp", f"WITH {S.KINETICS} SELECT i, j, round(max(p), 8) AS p FROM (SELECT t, i, j, sum(kin.p * ev.p) AS p FROM kin JOIN ev USING (state) WHERE t >= 3 AND t < 20 GROUP BY t, i, j) GROUP BY i, j")
def dotplot_maxbpp(spark, sf):
    return analysis.dotplot_max_events(B.kinetics(spark, sf), B.events(spark, sf), 3, 20)


@query("coarse_grained_pf", f"WITH {S.COARSE} SELECT coarse, total AS z FROM total")
def coarse_grained_pf(spark, sf):
    return analysis.coarse_weights(B.contributions(spark, sf), B.nation_weights(spark, sf))


@query("backpropagate", f"""WITH {S.COARSE} SELECT fine AS state, round(sum(part * z / total * p), 8) AS p
FROM part JOIN fine ON fine = state JOIN total USING (coarse) JOIN cp USING (coarse) GROUP BY fine""")  # fmt: skip
def backpropagate(spark, sf):
    most = analysis.max_over_time(B.region_kinetics(spark, sf), 0.01).select(F.col("state").alias("coarse"), F.col("max_p").alias("p"))
    return analysis.backpropagate(B.contributions(spark, sf), B.nation_weights(spark, sf), most)


@query("relevant_states", f"""WITH {S.COARSE} SELECT fine AS state, round(sum(part * z / total * p), 8) AS p
FROM part JOIN fine ON fine = state JOIN total USING (coarse) JOIN cp USING (coarse) GROUP BY fine HAVING sum(part * z / total * p) >= 0.01""")  # fmt: skip
def relevant_states(spark, sf):
    return analysis.relevant_states(B.region_kinetics(spark, sf), B.contributions(spark, sf), B.nation_weights(spark, sf))


@query("coarse_grained_events", f"""WITH {S.COARSE} SELECT coarse AS state, i, j, round(sum(part * ne.p * z / total), 8) AS p
FROM part JOIN fine ON fine = state JOIN total USING (coarse) JOIN ne ON ne.state = fine GROUP BY coarse, i, j""")  # fmt: skip
def coarse_grained_events(spark, sf):
    return analysis.coarse_events(B.contributions(spark, sf), B.nation_weights(spark, sf), B.nation_events(spark, sf))


@query("average_trajectories", f"""WITH d AS (SELECT event_type AS species, {S._DAY} AS t, count(*) AS n FROM events GROUP BY 1, 2)
SELECT t, species, round(sum(n) OVER (PARTITION BY species ORDER BY t) / (SELECT count(DISTINCT user_id) FROM events), 8) AS mean FROM d""")  # fmt: skip
def average_trajectories(spark, sf):
    users = B.table(spark, sf, "events").select("user_id").distinct().count()
    return analysis.average_trajectories(B.trajectories(spark, sf), users)


# exports


@query("states_export", f"WITH {S.SITES} SELECT run_id, concat_ws(chr(9), printf('%.6f', energy / 100.0), i1, i2, j1, j2) AS line FROM sites")
def states_export(spark, sf):
    sites = _sites(B.runs(spark, sf))
    return sites.select("run_id", landscape.state_line().alias("line"))


@query("rxns_export", f"WITH {S.TRADE} SELECT 'S' || (s + 1) || ' -> S' || (t + 1) || ', ' || printf('%.8e', w / z) AS line FROM ends JOIN nodes ON s = b")
def rxns_export(spark, sf):
    nodes, edges = _trade(spark, sf)
    return exports.reactions(nodes, edges, "S")


@query("spcs_export", f"WITH {S.TRADE} SELECT 'S' || (b + 1) || ' ' || CASE WHEN b = 1 THEN 1 ELSE 0 END AS line FROM nodes")
def spcs_export(spark, sf):
    return exports.species(_trade(spark, sf)[0], "S", 1)


@query("pf_matrix", f"WITH {S.TRADE} SELECT s AS i, t AS j, w AS v FROM ends UNION ALL SELECT b, b, z FROM nodes")
def pf_matrix(spark, sf):
    return exports.weight_matrix(*_trade(spark, sf))


@query("pseudo_bar", f"WITH {S.TRADE} SELECT b + 1 AS rank, '-' AS structure, round(-ln(z), 6) AS energy FROM nodes", 6)
def pseudo_bar(spark, sf):
    return exports.pseudo_bar(_trade(spark, sf)[0])


@query("rate_lines", f"""WITH {S.TRADE_RUNS}, off AS (SELECT e.run_id, s AS i, t AS j, w / z AS r FROM rends e JOIN rnodes n ON n.run_id = e.run_id AND b = s),
every AS (SELECT run_id, i, j, r FROM off UNION ALL SELECT run_id, i, i, -sum(r) FROM off GROUP BY run_id, i),
cell AS (SELECT x.run_id, i, unnest(range(last + 1)) AS j FROM (SELECT DISTINCT run_id, i FROM every) x JOIN (SELECT run_id, max(j) AS last FROM every GROUP BY run_id) y ON x.run_id = y.run_id)
SELECT c.run_id, c.i, string_agg(lpad(printf('%.4g', coalesce(r, 0)), 10, ' '), ' ' ORDER BY c.j) AS line FROM cell c LEFT JOIN every e ON e.run_id = c.run_id AND e.i = c.i AND e.j = c.j GROUP BY c.run_id, c.i""")  # fmt: skip
def rate_lines(spark, sf):
    return exports.rate_lines(ctmc.rate_matrix(*_trade_runs(spark, sf)))


@query("kinetics_lines", f"WITH {S.KINETICS} SELECT t, printf('%.6e', CAST(t AS DOUBLE)) || ' ' || string_agg(printf('%.6g', p), ' ' ORDER BY state) AS line FROM kin GROUP BY t")
def kinetics_lines(spark, sf):
    return exports.kinetics_lines(B.kinetics(spark, sf).select(F.col("t").cast("double").alias("t"), F.col("state").alias("b"), "p")).withColumn("t", F.col("t").cast("long"))


@query("basin_report", f"""WITH {S.TRADE}, near AS (SELECT s AS b, string_agg(t, ' ' ORDER BY t) AS neighbours FROM ends GROUP BY s)
SELECT n.b, CAST(length(n_name) AS BIGINT) AS n_states, round(-{S.RT!r} * ln(n.z), 8) AS free_energy, round(p, 8) AS p, round(out_rate, 8) AS out_rate, coalesce(neighbours, '') AS neighbours
FROM nodes n JOIN shares USING (b) JOIN rates USING (b) JOIN nation ON n_nationkey = n.b LEFT JOIN near USING (b)""")  # fmt: skip
def basin_report(spark, sf):
    sizes = B.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("b"), F.length("n_name").cast("long").alias("n_states"))
    return exports.basin_report(*_trade(spark, sf), sizes)


@query("prune_track", f"WITH {S.COARSE} SELECT coarse AS final, string_agg(fine || ':' || printf('%.3g', part), chr(9) ORDER BY fine) AS track FROM part GROUP BY coarse")
def prune_track(spark, sf):
    return exports.prune_track(B.contributions(spark, sf).select(F.col("coarse").alias("final"), F.col("fine").alias("basin"), "part"))
