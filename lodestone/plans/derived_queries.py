"""Rules, lookups, defaults and verdicts over rows that are derived from the given tables, in Spark and in SQL alike, so that each of them fires both ways."""

from __future__ import annotations

import importlib.util

from pyspark.sql import functions as F

from lodestone.functions import lexicons as L
from lodestone.functions import rules as R
from lodestone.operators import automaton as A
from lodestone.operators import judgement
from lodestone.operators import statistics as S
from lodestone.plans.lexicon_queries import LATIN, RENDERED, WORDED, re2, shipped_rows, worded
from lodestone.plans.registry import query
from lodestone.session import table_path
from lodestone.sources import lexicons as X
from lodestone.sources import readers, sinks

_WORDED = "text"
for _old, _new in WORDED:
    _WORDED = f"replace({_WORDED}, '{_old}', '{_new}')"


@query("JN11", """
WITH p AS (SELECT event_id AS ordinal, CASE user_id % 3 WHEN 0 THEN upper(event_type) WHEN 1 THEN lower(event_type) ELSE upper(event_type[1]) || event_type[2:] END AS party, ['O','C','L','N'][(floor(value)::INT % 4 + 4) % 4 + 1] AS state, user_id FROM events),
f AS (SELECT user_id, lower(party) AS party, arg_min(state, ordinal) AS state FROM p GROUP BY ALL),
a AS (SELECT event_id, user_id, CASE WHEN event_id % 6 = 0 THEN 'nobody' ELSE event_type END AS name FROM events WHERE event_id % 2 = 0 OR event_id % 2 = 1)
SELECT event_id, name, state FROM a LEFT JOIN f ON a.user_id = f.user_id AND lower(name) = f.party""")
def party_lookup(t):
    """Names without regard to case, among the parties of a session; of several with one name, the first declared."""
    state = F.get(F.array(*map(F.lit, "OCLN")), F.pmod(F.floor("value").cast("int"), F.lit(4)))
    kind = F.col("event_type")
    party = F.when(F.col("user_id") % 3 == 0, F.upper(kind)).when(F.col("user_id") % 3 == 1, F.lower(kind)).otherwise(F.concat(F.upper(F.substring(kind, 1, 1)), F.substr(kind, F.lit(2))))
    first = t("events").select("user_id", F.lower(party).alias("party"), state.alias("state"), "event_id").groupBy("user_id", "party").agg(F.min_by("state", "event_id").alias("state"))
    letters = t("events").select("event_id", F.col("user_id").alias("u"), F.when(F.col("event_id") % 6 == 0, "nobody").otherwise(kind).alias("name"))
    return letters.join(first, (F.col("u") == F.col("user_id")) & (F.lower("name") == F.col("party")), "left").select("event_id", "name", "state")


def _seeds(modals: dict[str, str], cues: list[str]) -> list[str]:
    return [*modals, *cues, "x"]


_MORPH = {"arabic": (L.ARABIC_MODALS, L.ARABIC_NEGATIONS, L.ARABIC_MARKS, False, "[" + chr(0x64B) + "-" + chr(0x65F) + "]"), "hebrew": (L.HEBREW_MODALS, L.HEBREW_NEGATIONS, L.HEBREW_MARKS, True, "[" + chr(0x591) + "-" + chr(0x5C7) + "]")}
#: Letters without those of the modals and cues of one or two letters, so that words come in by the seeds alone; every 29th letter carries a mark.
_PLAIN = {"arabic": "بتثجحخدذرزسشصضطظعغفقكهوبتث", "hebrew": "בגדהוזחטכמנסעפצקרשתבגדהוזח"}


def _morphological_sql() -> str:
    parts = []
    for at, (name, (modals, cues, _, tokens, marks)) in enumerate(_MORPH.items()):
        seeds = "[" + ", ".join(f"'{w}'" for w in _seeds(modals, cues)) + "]"
        n = len(_seeds(modals, cues))
        mark = chr(0x64E) if name == "arabic" else chr(0x5B7)
        text = f"translate(lower(text), '{LATIN}', '{_PLAIN[name]}') || ' ' || {seeds}[doc_id // 2 % {n} + 1] || '{mark} ' || {seeds}[doc_id // 3 % {n} + 1]"
        hit = f"list_has_any(string_split_regex(x, '\\s+'), {cues})" if tokens else "(" + " OR ".join(f"contains(x, '{c}')" for c in cues) + ")"
        modal = "CASE " + " ".join(f"WHEN contains(x, '{m}') THEN '{m}'" for m in modals) + " END"
        state = "CASE modal " + " ".join(f"WHEN '{m}' THEN '{s}'" for m, s in modals.items()) + " ELSE 'OBLIGATION' END"
        parts.append(
            f"SELECT doc_id, modal, {state} AS state, CASE WHEN modal IS NULL THEN 'unknown' ELSE 'prescriptive' END AS context, negated, CASE WHEN modal IS NULL THEN 0.5::DOUBLE ELSE 0.7 END AS confidence "
            f"FROM (SELECT doc_id, {modal} AS modal, {hit} AS negated FROM (SELECT doc_id, regexp_replace({text}, '{marks}', '', 'g') AS x FROM documents WHERE doc_id % 2 = {at}))"
        )
    return " UNION ALL ".join(parts)


@query("RUL16", _morphological_sql())
def morphological_states(t):
    """Documents in Arabic and in Hebrew letters, with words of the tables behind them."""
    found, c = None, F.col("text")
    for at, (name, (modals, cues, marks, tokens, _)) in reversed([*enumerate(_MORPH.items())]):
        seeds = F.array(*map(F.lit, _seeds(modals, cues)))
        word = lambda k, s=seeds: F.get(s, F.pmod(F.floor(F.col("doc_id") / k), F.size(s)).cast("int"))
        mark = chr(0x64E) if name == "arabic" else chr(0x5B7)
        text = F.concat(F.translate(F.lower(c), LATIN, _PLAIN[name]), F.lit(" "), word(2), F.lit(f"{mark} "), word(3))
        # Null for the other script's documents: normalisation in Python runs for every row, whatever the branch.
        own = R.morphological(F.when(F.pmod("doc_id", F.lit(2)) == at, text), modals, cues, marks, tokens)
        found = own if found is None else F.when(F.col("doc_id") % 2 == 0, own).otherwise(found)
    return t("documents").select("doc_id", F.explode(F.array(found)).alias("f")).select("doc_id", "f.*")


#: Letters for a to z among which are predicates, modals, negations, particles and nominals of the positional rules.
_CHINESE = "天地山水火殺金土日不月可星風被雨雷君必愛之也義命石仁"


def _positional_sql() -> str:
    c = L.CHINESE
    predicates = "".join(c["predicates"])
    bond = "CASE p " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in c["predicates"].items()) + " END"
    modal = "CASE " + " ".join(f"WHEN contains(x, '{m}') THEN '{m}'" for m in c["modals"]) + " END"
    state = "CASE modal " + " ".join(f"WHEN '{m}' THEN '{s}'" for m, s in c["modals"].items() if s) + " END"
    return f"""
WITH x AS (SELECT item_id, translate(lower(text), '{LATIN}', '{_CHINESE}') AS x FROM benchmark), y AS (SELECT item_id, x, nullif(regexp_extract(x, '[{predicates}]'), '') AS p, {modal} AS modal FROM x)
SELECT item_id, {bond} AS bond, {state} AS state, modal, regexp_matches(x, '[{c["negation"]}]') AS negated, regexp_matches(x, '[{c["passive"]}]') AS passive, regexp_matches(x, '[{c["causative"]}]') AS causative FROM y"""


@query("RUL15", _positional_sql())
def positional_bonds(t):
    b = R.positional(F.translate(F.lower("text"), LATIN, _CHINESE))
    rows = t("benchmark").select("item_id", F.explode(F.array(b)).alias("b"))
    return rows.select("item_id", F.col("b.bond_type").alias("bond"), "b.state", "b.modal", "b.negated", "b.passive", "b.causative")


@query("RUL20", """
WITH v AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN to_json({'bond': 'CARE', 'state': 'RIGHT', 'confidence': (n_chars % 10 / 10.0)::VARCHAR})::VARCHAR WHEN 1 THEN text WHEN 2 THEN '{"bond": "HARM", "state": "CLAIM", "confidence": "high"}' WHEN 3 THEN NULL ELSE '{}' END AS raw FROM documents),
p AS (SELECT doc_id, CASE WHEN json_valid(raw) THEN raw::JSON END AS j FROM v), q AS (SELECT doc_id, j->>'$.bond' AS bond, j->>'$.state' AS state, try_cast(j->>'$.confidence' AS DOUBLE) AS confidence FROM p)
SELECT doc_id, CASE WHEN confidence IS NULL THEN 'NEUTRAL' ELSE bond END AS bond, CASE WHEN confidence IS NULL THEN 'LIBERTY' ELSE state END AS state, coalesce(confidence, 0.1) AS confidence FROM q""")
def row_defaults(t):
    """A row that cannot be read (a text that is no JSON, a field that is no number, nothing at all) has the default; no error reaches the query."""
    k = F.col("doc_id") % 5
    good = F.to_json(F.struct(F.lit("CARE").alias("bond"), F.lit("RIGHT").alias("state"), (F.col("n_chars") % 10 / 10).cast("string").alias("confidence")))
    raw = F.when(k == 0, good).when(k == 1, F.col("text")).when(k == 2, F.lit('{"bond": "HARM", "state": "CLAIM", "confidence": "high"}')).when(k == 4, F.lit("{}"))
    v = t("documents").select("doc_id", F.from_json(raw, "bond string, state string, confidence string").alias("j"))
    confidence = F.col("j.confidence").try_cast("double")
    bad = confidence.isNull()
    return v.select("doc_id", F.when(bad, "NEUTRAL").otherwise(F.col("j.bond")).alias("bond"), F.when(bad, "LIBERTY").otherwise(F.col("j.state")).alias("state"), F.coalesce(confidence, F.lit(0.1)).alias("confidence"))


@query("EXP8 SRC3", """
SELECT user_id AS session, event_id AS "case", party, state, expected FROM (
  SELECT user_id, event_id, unnest([{'party': 'A', 'state': ['O','C','L','N'][(floor(value)::INT % 4 + 4) % 4 + 1], 'expected': CASE WHEN event_id % 5 <> 0 THEN 'O' END}, {'party': 'B', 'state': 'C', 'expected': 'C'}][1:event_id % 3], recursive := true) FROM events)""")
def exploded_verdicts(t):
    """Trials of none to two verdicts each, logged as lines and read back as a session."""
    df = t("events")
    state = F.get(F.array(*map(F.lit, "OCLN")), F.pmod(F.floor("value").cast("int"), F.lit(4)))
    a = F.struct(F.lit("A").alias("party_name"), state.alias("state"), F.when(F.col("event_id") % 5 != 0, "O").alias("expected"))
    b = F.struct(F.lit("B").alias("party_name"), F.lit("C").alias("state"), F.lit("C").alias("expected"))
    log = df.select(F.col("event_id").cast("string").alias("trial_id"), F.col("user_id").cast("string").alias("session_id"), F.slice(F.array(a, b), F.lit(1), (F.col("event_id") % 3).cast("int")).alias("verdicts"))
    path = table_path(df.sparkSession, "session-log")
    sinks.json_lines(log, path)
    rows = readers.json_lines(df.sparkSession, path, readers.TRIALS, "*.json").select("session_id", "trial_id", F.explode("verdicts").alias("v"))
    return rows.select(F.col("session_id").cast("long").alias("session"), F.col("trial_id").cast("long").alias("case"), F.col("v.party_name").alias("party"), "v.state", "v.expected")


_DIMENSIONS = {"view": "HARM", "click": "RIGHTS", "purchase": "FAIRNESS", "signup": "SOCIETAL", "error": "PROCEDURAL"}


@query("AG15", f"""
WITH d AS (SELECT CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _DIMENSIONS.items())} END AS dimension, avg(value) AS w FROM events GROUP BY ALL),
n(dimension, name) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in L.WEIGHT_NAMES.items())}),
r AS (SELECT name, coalesce(w, 0.1)::DOUBLE AS w FROM n LEFT JOIN d USING (dimension)), a AS (SELECT * FROM r UNION ALL SELECT 'virtue_care', w * 0.5 FROM r WHERE name = 'societal_environmental')
SELECT name, round(w / (SELECT sum(w) FROM a), 9) AS weight FROM a""")
def exported_weights(t):
    """Mean values by dimension under their exported names: procedural ones are dropped, missing ones have the default."""
    kinds = F.create_map(*[F.lit(x) for kv in _DIMENSIONS.items() for x in kv])
    d = t("events").groupBy(F.try_element_at(kinds, F.col("event_type")).alias("dimension")).agg(F.avg("value").alias("w"))
    return judgement.remapped_weights(d, "dimension", "w").withColumn("weight", F.round("weight", 9))


@query("ST11", """
WITH e AS (SELECT user_id AS id, event_type AS kind, count(*) AS n, 1 + 3 * (max(value) - min(value)) / (max(value) + 1) AS r, (min(event_id) % 20) / 100.0::DOUBLE AS p, coalesce(stddev_pop(value) / avg(value), 0) AS d FROM events GROUP BY ALL),
l AS (SELECT *, CASE WHEN n >= 30 THEN 3.0 WHEN n >= 15 THEN 2.5 ELSE 2.0 END AS a, CASE WHEN n >= 30 THEN 2.0 WHEN n >= 15 THEN 1.8 ELSE 1.5 END AS b, CASE WHEN n >= 30 THEN 1.5 WHEN n >= 15 THEN 1.3 ELSE 1.2 END AS c, CASE WHEN n >= 30 THEN 0.01 WHEN n >= 15 THEN 0.05 ELSE 0.1 END AS q FROM e)
SELECT id, kind, n, CASE WHEN r >= a AND p < q AND d > 0.8 THEN 'STRONG_SUPPORT' WHEN r >= b AND p < 0.05 AND d > 0.5 THEN 'MODERATE_SUPPORT' WHEN r >= c AND p < 0.1 THEN 'WEAK_SUPPORT' ELSE 'NOT_SUPPORTED' END AS verdict FROM l""")
def effect_verdicts(t):
    """How well the spread of a user's values of one kind is supported; limits depend on how many there are."""
    v = F.col("value")
    e = t("events").groupBy(F.col("user_id").alias("id"), F.col("event_type").alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), (1 + 3 * (F.max(v) - F.min(v)) / (F.max(v) + 1)).alias("r"), (F.min("event_id") % 20 / 100.0).alias("p"), F.coalesce(F.stddev_pop(v) / F.avg(v), F.lit(0.0)).alias("d")
    )
    return e.select("id", "kind", "n", S.verdict(F.col("r"), F.col("p"), F.col("d"), F.col("n")).alias("verdict"))


#: One split a source: it transfers where most of its labelled texts are good, and is invariant where few are toxic; untested without enough labels of good texts.
_SPLITS = """s AS (
  SELECT source AS split, avg(quality) > 0.85 AS t, CASE WHEN count(*) FILTER (WHERE quality = 1) >= {least} THEN avg(toxic) < 0.12 END AS i FROM documents JOIN labels USING (doc_id) GROUP BY source
), size AS (SELECT count(*) FROM labels)""".replace("{least}", "(SELECT count(*) / 25 FROM labels)")
_VERDICT = "CASE WHEN i IS NULL THEN CASE WHEN t THEN 'PARTIAL' ELSE 'FAIL' END WHEN t AND i THEN 'SUCCESS' WHEN t THEN 'LEAK' WHEN i THEN 'WEAK' ELSE 'FAIL' END"


def _splits(t):
    rows = t("documents").join(t("labels"), "doc_id")
    n = t("labels").agg((F.count(F.lit(1)) / 25).alias("least"))
    by = rows.groupBy(F.col("source").alias("split")).agg((F.avg("quality") > 0.85).alias("t"), F.count_if(F.col("quality") == 1).alias("good"), (F.avg("toxic") < 0.12).alias("i"))
    return by.join(F.broadcast(n), F.lit(True)).select("split", "t", F.when(F.col("good") >= F.col("least"), F.col("i")).alias("i"))


@query("ST22", f"""
WITH {_SPLITS}, v AS (SELECT split, {_VERDICT} AS verdict FROM s)
SELECT split, verdict, (SELECT CASE WHEN count(*) FILTER (WHERE verdict = 'SUCCESS') >= 2 THEN 'STRONGLY_SUPPORTED' WHEN count(*) FILTER (WHERE verdict = 'SUCCESS') = 1 THEN 'SUPPORTED'
  WHEN count(*) FILTER (WHERE verdict = 'LEAK') > 0 THEN 'CHALLENGED' WHEN count(*) FILTER (WHERE verdict = 'PARTIAL') >= 2 THEN 'PROVISIONAL' ELSE 'NOT_SUPPORTED' END FROM v) AS overall FROM v""")
def verdict_ladder(t):
    v = _splits(t).select("split", S.split_verdict(F.col("t"), F.col("i")).alias("verdict"))
    return v.join(F.broadcast(S.overall_verdict(v, "verdict")), F.lit(True))


@query("ST23", f"""
WITH {_SPLITS}
SELECT 'cross_linguistic' AS claim, CASE WHEN bool_or(t) THEN 'supported' ELSE 'falsified' END AS status FROM s WHERE split IN ('src1', 'src2')
UNION ALL SELECT 'language_invariance', CASE WHEN count(i) = 0 THEN 'untested' WHEN bool_or(i) THEN 'supported' ELSE 'falsified' END FROM s
UNION ALL SELECT 'universal_invariance', CASE WHEN count(i) = 0 THEN 'untested' WHEN bool_and(i) THEN 'supported' ELSE 'falsified' END FROM s
UNION ALL SELECT 'temporal_transfer', CASE WHEN count(*) = 0 THEN 'untested' WHEN bool_or(t) THEN 'supported' ELSE 'falsified' END FROM s WHERE split = 'no such split'""")
def claims(t):
    s = _splits(t)
    transfer, invariant = F.col("t"), F.col("i")

    def status(tested, held):
        return F.when(~tested, "untested").when(held, "supported").otherwise("falsified")

    cross = s.where(F.col("split").isin("src1", "src2")).agg(F.lit("cross_linguistic").alias("claim"), F.when(F.bool_or(transfer), "supported").otherwise("falsified").alias("status"))
    some = s.agg(F.lit("language_invariance").alias("claim"), status(F.count("i") > 0, F.bool_or(invariant)).alias("status"))
    every = s.agg(F.lit("universal_invariance").alias("claim"), status(F.count("i") > 0, F.bool_and(invariant)).alias("status"))
    time = s.where("split = 'no such split'").agg(F.lit("temporal_transfer").alias("claim"), status(F.count(F.lit(1)) > 0, F.bool_or(transfer)).alias("status"))
    return cross.unionByName(some).unionByName(every).unionByName(time)


_SAID = "CASE doc_id % 7 WHEN 0 THEN 'I should ' WHEN 1 THEN 'you  MUST ' WHEN 2 THEN 'Anna ought ' WHEN 3 THEN 'anna must ' WHEN 4 THEN 'He said I must ' ELSE '' END || text || CASE doc_id % 3 WHEN 0 THEN ' help the' WHEN 1 THEN ' Protect  Ben' ELSE '' END"


@query("PRJ22", f"""
WITH s AS (SELECT doc_id, {_SAID} AS s FROM documents), p AS (SELECT doc_id, s, lower(regexp_extract(s, '(?i)(help|protect|harm|hurt)[\\s]+([\\p{{L}}\\p{{N}}_]+)', 2)) AS p FROM s)
SELECT doc_id, CASE WHEN regexp_matches(s, '(?i)^I\\s+(should|must|ought)') THEN 'speaker' WHEN regexp_matches(s, '(?i)^You\\s+(should|must|ought)') THEN 'addressee' ELSE nullif(lower(regexp_extract(s, '^([A-Z][a-z]+)\\s+(should|must|ought)', 1)), '') END AS agent,
  CASE WHEN p <> '' AND p NOT IN ('the', 'a', 'an', 'my', 'your') THEN p END AS patient FROM p""")
def captured_roles(t):
    k = F.col("doc_id")
    front = F.when(k % 7 == 0, "I should ").when(k % 7 == 1, "you  MUST ").when(k % 7 == 2, "Anna ought ").when(k % 7 == 3, "anna must ").when(k % 7 == 4, "He said I must ").otherwise("")
    behind = F.when(k % 3 == 0, " help the").when(k % 3 == 1, " Protect  Ben").otherwise("")
    rows = t("documents").select("doc_id", F.explode(F.array(F.concat(front, "text", behind))).alias("s"))
    return rows.select("doc_id", R.role_capture(F.col("s")).alias("r")).select("doc_id", "r.agent", "r.patient")


def _gates_sql() -> str:
    weight = L.ENGLISH_WEIGHT
    one = lambda p: re2(p.lower(), True)
    items = ", ".join(f"CASE WHEN regexp_matches(t, '{one(p)}') THEN {{'k': '{k}', 't': '{trigger}', 'c': {c}::DOUBLE}} END" for k, p, trigger, c, _ in L.GATES if not p.count("{"))
    return f"""
WITH d AS (SELECT doc_id, '  ' || regexp_replace(lower({_WORDED}), '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g') || '  ' AS t FROM documents), g AS (SELECT doc_id, list_filter([{items}], lambda x: x IS NOT NULL) AS g FROM d),
s AS (SELECT doc_id, g, list_sum(list_transform(list_filter(g, lambda x: x.k = 'binding'), lambda x: x.c * {weight})) AS o, list_sum(list_transform(list_filter(g, lambda x: x.k = 'release'), lambda x: x.c * {weight})) AS l FROM g)
SELECT doc_id, array_to_string(list_transform(g, lambda x: x.t), ',') AS triggers, CASE WHEN coalesce(o, 0) = 0 AND coalesce(l, 0) = 0 THEN NULL WHEN coalesce(o, 0) >= coalesce(l, 0) THEN 'O' ELSE 'L' END AS state,
  CASE WHEN coalesce(o, 0) > 0 OR coalesce(l, 0) > 0 THEN round(least(greatest(coalesce(o, 0), coalesce(l, 0)), 1), 9) END AS confidence FROM s"""


@query("RUL21 RUL23", _gates_sql())
def shipped_gates(t):
    """The gates of the package over texts with words of its lexicons; the two with counted gaps have a unit test."""
    table = [g for g in L.GATES if not g[1].count("{")]
    rows = t("documents").select("doc_id", F.explode(F.array(R.gates(worded(F.col("text")), table))).alias("g"))
    state = R.gate_state(F.col("g"))
    return rows.select("doc_id", F.array_join(F.transform("g", lambda x: x["trigger"]), ",").alias("triggers"), state["state"].alias("state"), F.round(state["confidence"], 9).alias("confidence"))


if importlib.util.find_spec("yaml"):

    def _context_sql() -> str:
        rows = [r for r in shipped_rows() if r[0] == "english"]
        bonds = [(c, p) for _, k, c, _, _, p in rows if k == "bond"]
        # A blank in front takes the place of the character that a boundary takes.
        pats = [re2(p).replace("(?:^|", "(?:") for _, p in bonds]
        first = "CASE " + " ".join(f"WHEN regexp_matches(' ' || x, '{p}') THEN {i}" for i, p in enumerate(pats, 1)) + " END"
        place = "CASE i " + " ".join(f"WHEN {i} THEN length(regexp_extract(' ' || x, '(?s)^(.*?)(?:{p})', 1))" for i, p in enumerate(pats, 1)) + " END"
        classes = "[" + ", ".join(f"'{c}'" for c, _ in bonds) + "]"
        any_of = lambda kind: " OR ".join(f"regexp_matches(w, '{p.replace(chr(39), chr(39) * 2)}')" for _, k, c, _, _, p in rows if k == "context" and c == kind)
        return f"""
WITH d AS (SELECT doc_id, lower({_WORDED}) AS x FROM documents), f AS (SELECT doc_id, x, {first} AS i FROM d),
p AS (SELECT doc_id, x, i, {place} AS pos FROM f),
w AS (SELECT doc_id, i, substr(x, greatest(pos - 30, 0)::BIGINT + 1, (least(pos + 30, length(x)) - greatest(pos - 30, 0))::BIGINT) AS w FROM p),
m AS (SELECT doc_id, i, CASE WHEN i IS NULL THEN NULL WHEN {any_of('prohibition')} THEN 'prohibition' WHEN {any_of('obligation')} THEN 'obligation' WHEN {any_of('permission')} THEN 'permission' WHEN {any_of('negation')} THEN 'negated' END AS marker FROM w)
SELECT doc_id, coalesce({classes}[i], 'NONE') AS bond, CASE WHEN i IS NULL THEN 'unknown' WHEN marker IN ('prohibition', 'obligation', 'permission') THEN 'prescriptive' ELSE 'descriptive' END AS context, marker,
  CASE WHEN i IS NULL THEN 'low' WHEN marker IN ('prohibition', 'obligation', 'permission') THEN 'high' ELSE 'medium' END AS confidence FROM m"""

    @query("RUL12 RUL27", _context_sql())
    def worded_confidence(t):
        """The first pattern that matches, by order of precedence, and the markers within thirty characters of the place where it does first."""
        rows = X.loaded(X.shipped(t.spark, "english"))
        markers: dict[str, list[str]] = {}
        for _, kind, class_, p in rows:
            if kind == "context":
                markers.setdefault(class_, []).append(p)
        text = F.lower(worded(F.col("text")))
        docs = t("documents").select("doc_id", F.explode(F.array(text)).alias("text"))
        m = A.match_lexicon(docs, [r for r in rows if r[1] == "bond"], ["doc_id", "text"], F.col("text"))
        m = m.select("doc_id", "text", F.get("matches", F.lit(0)).alias("m"))
        there = F.col("m").isNotNull()
        m = m.select("doc_id", "m", F.explode(F.array(F.when(there, R.window_context(F.col("text"), F.col("m.at"), markers)))).alias("c"))
        context = F.coalesce("c.context", F.lit("unknown"))
        return m.select("doc_id", F.coalesce("m.class", F.lit("NONE")).alias("bond"), context.alias("context"), F.col("c.marker").alias("marker"), F.when(~there, "low").when(context == "prescriptive", "high").otherwise("medium").alias("confidence"))
