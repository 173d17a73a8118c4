"""Exact intervals, loops of group elements, shares of variance, and random perturbations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import dihedral as H
from lodestone.functions import special as D
from lodestone.functions import vectors as V
from lodestone.operators import perturb as P
from lodestone.operators import statistics as S
from lodestone.plans.registry import query

_TAIL = "list_sum(list_transform(range({a}, {b} + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(m) + (n - i) * ln(1 - m))))"


@query("", f"""
WITH RECURSIVE s AS (SELECT lang, count(*) AS n, sum(toxic)::BIGINT AS k FROM documents JOIN labels USING (doc_id) GROUP BY lang),
lo AS (
  SELECT lang, n, k, 0::DOUBLE AS a, 1::DOUBLE AS b, 0 AS step FROM s
  UNION ALL
  SELECT lang, n, k, CASE WHEN t < 0.025 THEN m ELSE a END, CASE WHEN t < 0.025 THEN b ELSE m END, step + 1 FROM (SELECT *, {_TAIL.format(a='k', b='n')} AS t FROM (SELECT *, (a + b) / 2 AS m FROM lo WHERE step < 45))
), hi AS (
  SELECT lang, n, k, 0::DOUBLE AS a, 1::DOUBLE AS b, 0 AS step FROM s
  UNION ALL
  SELECT lang, n, k, CASE WHEN t < 0.025 THEN a ELSE m END, CASE WHEN t < 0.025 THEN m ELSE b END, step + 1 FROM (SELECT *, {_TAIL.format(a='0', b='k')} AS t FROM (SELECT *, (a + b) / 2 AS m FROM hi WHERE step < 45))
)
SELECT s.lang, s.n, s.k, round(CASE WHEN s.k = 0 THEN 0 ELSE lo.a END, 9) AS low, round(CASE WHEN s.k = s.n THEN 1 ELSE hi.b END, 9) AS high
FROM s JOIN lo ON s.lang = lo.lang AND lo.step = 45 JOIN hi ON s.lang = hi.lang AND hi.step = 45""")
def label_intervals(t):
    """Toxic texts by language, with the exact 95 % interval of their share."""
    s = t("documents").join(t("labels"), "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").cast("long").alias("k"))
    both = D.clopper_pearson(F.col("k"), F.col("n"))
    return s.select("lang", "n", "k", F.round(both["low"], 9).alias("low"), F.round(both["high"], 9).alias("high"))


_STEPS = """
steps AS (
  SELECT user_id AS session, ts, event_id, ((props->>'$.k')::INT % 8 + 8) % 8 // 4 AS m, ((props->>'$.k')::INT % 4 + 4) % 4 AS k, ((floor(value)::INT % 4) + 4) % 4 AS state FROM events
), turned AS (
  SELECT *, coalesce(sum(m) OVER (PARTITION BY session ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS later FROM steps
), products AS (
  SELECT session, count(*) AS steps, sum(m) % 2 AS m, ((sum(CASE WHEN later % 2 = 1 THEN -k ELSE k END) % 4) + 4) % 4 AS k, arg_min(state, (ts, event_id)) AS a, arg_max(state, (ts, event_id)) AS b FROM turned GROUP BY session
), loops AS (
  SELECT session, steps, ['e','r','r2','r3','s','sr','sr2','sr3'][(m * 4 + k + 1)::INT] AS element, ['O','C','L','N'][a + 1] AS initial, ['O','C','L','N'][b + 1] AS final,
    ((CASE WHEN m = 1 THEN 1 - a ELSE a END + k) % 4 + 4) % 4 = b AS matched FROM products
)"""


def _loops(t):
    k = F.get_json_object("props", "$.k").cast("int")
    e = t("events").select(
        F.col("user_id").alias("session"), "ts", "event_id", F.get(F.array(*map(F.lit, H.ELEMENTS)), F.pmod(k, F.lit(8))).alias("element"),
        F.get(F.array(*map(F.lit, H.STATES)), F.pmod(F.floor("value").cast("int"), F.lit(4))).alias("state"),
    )
    return H.loops(e, "session", ["ts", "event_id"], "element", "state")


@query("", f"WITH {_STEPS} SELECT * FROM loops")
def session_loops(t):
    """Of each session, the product of its steps, and whether it takes the first state to the last."""
    return _loops(t)


@query("", f"WITH {_STEPS} SELECT steps % 3 AS kind, count(*) AS n, round(avg(matched::INT), 9) AS w FROM loops GROUP BY ALL")
def loop_observable(t):
    """The share of sessions whose last state is the one that their steps lead to, by the length modulo three."""
    rows = _loops(t).groupBy((F.col("steps") % 3).alias("kind"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("matched").cast("double")), 9).alias("w"))


@query("", """
WITH v AS (SELECT label AS a, vec_id % 3 AS b, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
g AS (SELECT i, avg(x) AS m FROM v GROUP BY i), ma AS (SELECT a, i, avg(x) AS m FROM v GROUP BY ALL), mb AS (SELECT b, i, avg(x) AS m FROM v GROUP BY ALL), mc AS (SELECT a, b, i, avg(x) AS m FROM v GROUP BY ALL),
s AS (
  SELECT sum((ma.m - g.m) ** 2) AS first, sum((mb.m - g.m) ** 2) AS second, sum((mc.m - g.m) ** 2) AS cells, sum((x - mc.m) ** 2) AS within, sum((x - g.m) ** 2) AS total
  FROM v JOIN g ON v.i = g.i JOIN ma ON v.i = ma.i AND v.a = ma.a JOIN mb ON v.i = mb.i AND v.b = mb.b JOIN mc ON v.i = mc.i AND v.a = mc.a AND v.b = mc.b
), k AS (SELECT count(DISTINCT a) AS a, count(DISTINCT b) AS b, count(DISTINCT (a, b)) AS c, count(DISTINCT vec_id) AS n FROM v), r AS (
  SELECT 'first' AS factor, a - 1 AS degrees, first AS squares FROM s, k UNION ALL SELECT 'second', b - 1, second FROM s, k UNION ALL SELECT 'interaction', c - a - b + 1, cells - first - second FROM s, k
  UNION ALL SELECT 'within', n - c, within FROM s, k UNION ALL SELECT 'total', n - 1, total FROM s, k
)
SELECT factor, degrees, round(squares, 4) AS squares, round(squares / (SELECT total FROM s), 6) AS eta_squared FROM r""")
def variance_shares(t):
    """Shares of the variance of vectors by label, a second factor, both together and neither."""
    out = S.variance_shares(t("embeddings").withColumn("part", F.col("vec_id") % 3), "label", "part", "embedding", 64)
    return out.select("factor", "degrees", F.round("squares", 4).alias("squares"), F.round("eta_squared", 6).alias("eta_squared"))


#: Words that the synthetic texts hold.
_SYNONYMS = {"the": ["a", "this", "that"], "of": ["from", "by"], "and": ["or", "plus"], "und": ["oder"], "de": ["des", "du"], "in": ["at"]}
_NAMES = ["Then", "Thing", "Erha", "Ation", "The"]
_DETAILS = ["It was a clear day.", "The room was quiet, they say.", "A clock struck nine."]


def _u(*salt: str) -> str:
    return "(('0x' || md5(concat_ws(':', id::VARCHAR, " + ", ".join(salt) + "))[1:8])::BIGINT / 4294967296::DOUBLE)"


def _pick(options: str, draw: str) -> str:
    return f"({options})[(floor({draw} * len({options})) + 1)::INT]"


def _list(items) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


def _perturb_sql() -> str:
    table = "CASE {w} " + " ".join(f"WHEN '{k}' THEN {_list(v)}" for k, v in _SYNONYMS.items()) + " END"
    bare = "trim(lower(w), '.,!?')"
    options = table.format(w=bare)
    new = _pick(options, _u("'synonym'", "(i - 1)::VARCHAR"))
    capital = f"CASE WHEN upper(w[1]) = w[1] AND lower(w[1]) <> w[1] THEN upper({new}[1]) || lower({new}[2:]) ELSE {new} END"
    word = f"CASE WHEN {options} IS NOT NULL AND {_u(chr(39) + 'swap' + chr(39), '(i - 1)::VARCHAR')} < 0.3 THEN ({capital}) || w[length({bare}) + 1:] ELSE w END"
    synonym = f"array_to_string(list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), lambda w, i: {word}), ' ')"
    name_of = lambda n: f"WHEN contains(text, '{n}') THEN replace(text, '{n}', {_pick(_list(x for x in _NAMES if x != n), _u(chr(39) + 'name' + chr(39)))})"
    name = f"CASE {' '.join(map(name_of, _NAMES))} ELSE text END"
    detail = _pick(_list(_DETAILS), _u("'detail'"))
    places = "list_filter(list_transform(string_split(text, ''), lambda c, i: CASE WHEN c IN (',', '.') THEN i END), lambda p: p IS NOT NULL)[1:3]"
    place = _pick(places, _u("'place'"))
    details = f"CASE WHEN {_u(chr(39) + 'insert' + chr(39))} < 0.7 AND length(text) > 20 THEN CASE WHEN {_u(chr(39) + 'end' + chr(39))} < 0.5 OR len({places}) = 0 THEN rtrim(text, ' ') || ' ' || {detail} ELSE text[1:{place}] || ' ' || {detail} || text[{place} + 1:] END ELSE text END"
    step = lambda k: f"CASE ops[{k}] WHEN 'synonym' THEN {synonym} WHEN 'name' THEN {name} WHEN 'detail' THEN {details} ELSE text END"
    ops = ", ".join(f"{{'u': {_u(chr(39) + 'op ' + n + chr(39))}, 'op': '{n}'}}" for n in ("synonym", "name", "detail"))
    return f"""
WITH d AS (SELECT doc_id AS id, text, list_transform(list_sort([{ops}]), lambda x: x.op)[1:CASE WHEN {_u("'count'")} < 0.5 THEN 1 ELSE 2 END] AS ops FROM (SELECT doc_id, doc_id AS id, text FROM documents)),
a AS MATERIALIZED (SELECT id, ops, {step(1)} AS text FROM d), b AS (SELECT id, ops, {step(2)} AS text FROM a)
SELECT id, array_to_string(ops, ',') AS ops, md5(text) AS text_md5 FROM b"""


@query("PT5", _perturb_sql())
def random_perturbations(t):
    out = P.random_surface(t("documents"), "doc_id", "text", _SYNONYMS, _NAMES, _DETAILS)
    return out.select("id", F.array_join("ops", ",").alias("ops"), F.md5("text").alias("text_md5"))


_PAIRS = {"obligation_to_permission": [(" the ", " a "), (" of ", " from ")], "harm_to_care": [(" and ", " or ")], "role_swap": [(" to ", " at ")]}
_SWAPPED_NAMES = {"The": "That", "And": "Or"}
_TAILS = ["It was Tuesday.", "in the city."]


def _battery_sql() -> str:
    structural = [(k, f"replace(text, '{a}', '{b}')") for k, pairs in _PAIRS.items() for a, b in pairs]
    renamed = "text"
    for a, b in _SWAPPED_NAMES.items():
        renamed = f"replace({renamed}, '{a}', '{b}')"
    rows = [f"SELECT doc_id AS id, true AS structural, '{k}' AS kind, text, {x} AS variant FROM documents" for k, x in structural]
    rows += [f"SELECT doc_id, false, '{k}', text, {x} FROM documents" for k, x in [("name_change", renamed), *[("detail", f"text || ' {d}'") for d in _TAILS]]]
    vector = lambda c: f"list_transform(string_split('0,1,2,3,4,5,6,7,8,9,a,b,c,d,e,f', ','), lambda d: len(list_filter({c}, lambda x: x = d))::DOUBLE)"
    digits = lambda c: f"list_transform(list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> ''), lambda w: md5(w)[1])"
    dot = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"
    return f"""b AS ({" UNION ALL ".join(rows)}), g AS MATERIALIZED (SELECT id, structural, kind, {digits("text")} AS x, {digits("variant")} AS y FROM b WHERE variant <> text),
v AS MATERIALIZED (SELECT id, structural, kind, {vector("x")} AS x, {vector("y")} AS y FROM g), d AS (SELECT id, structural, kind, 1 - {dot("x", "y")} / (sqrt({dot("x", "x")}) * sqrt({dot("y", "y")}) + 1e-9) AS distance FROM v)"""


def _battery(t):
    return P.battery(t("documents"), "doc_id", "text", _PAIRS, _SWAPPED_NAMES, _TAILS, V.hashed_words, V.add)


@query("PT6 ST1 AG18", f"WITH {_battery_sql()} SELECT structural, kind, count(*) AS n, round(avg(distance), 8) AS mean_distance, round(stddev_pop(distance), 8) AS deviation FROM d GROUP BY ALL")
def pair_battery(t):
    """How far structural and surface perturbations move the texts that they change, by kind."""
    by = _battery(t).groupBy("structural", "kind")
    return by.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("distance"), 8).alias("mean_distance"), F.round(F.stddev_pop("distance"), 8).alias("deviation"))


@query("PT6 ST8 ST9 ST11", f"""
WITH {_battery_sql()}, s AS (SELECT count(*) FILTER (WHERE structural) AS n1, avg(distance) FILTER (WHERE structural) AS m1, var_pop(distance) FILTER (WHERE structural) AS v1,
  count(*) FILTER (WHERE NOT structural) AS n2, avg(distance) FILTER (WHERE NOT structural) AS m2, var_pop(distance) FILTER (WHERE NOT structural) AS v2 FROM d)
SELECT n1, n2, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 6) AS cohens_d, round(m1 / m2, 6) AS ratio FROM s""")
def battery_effect(t):
    """Structural perturbations against surface ones."""
    e = S.effect_size(S.two_samples(_battery(t), "distance", F.col("structural")))
    return e.select("n1", "n2", F.round("cohens_d", 6).alias("cohens_d"), F.round("ratio", 6).alias("ratio"))
