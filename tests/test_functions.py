import itertools
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.functions import dihedral as D
from lodestone.functions import lexicons as L
from lodestone.functions import rules as R
from lodestone.functions import text as X


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first()["x"]


@pytest.fixture(autouse=True, scope="module")
def column(spark):
    """The text column of one(); columns take a running session."""
    globals()["C"] = F.col("t")


@pytest.mark.parametrize("text,n", [("", 0), (None, 0), ("  ", 0), ("a", 1), (" a\tb\n c ", 3)])
def test_word_count(spark, text, n):
    assert one(spark, text, X.word_count(C)) == n


def test_texts(spark):
    assert one(spark, "<b>Café</b>  x\n", X.clean_text(C)) == "Café x"
    assert one(spark, "in 1984 or 2001", X.year_of(C)) == 1984 and one(spark, "never", X.year_of(C)) == 1990
    assert one(spark, "x" * 51, X.shorten(C)) == "x" * 47 + "..." and one(spark, "x" * 50, X.shorten(C)) == "x" * 50
    assert one(spark, "Why, oh why me at all?", X.slug(C)) == "why_oh_why_me"
    assert one(spark, "dear you", X.with_opener(C, "Dear Reader,")) == "dear you"
    assert one(spark, "q", X.question_answer(C, F.lit(""))) == "QUESTION: q"
    assert [one(spark, v, X.confidence_weight(C)) for v in ("high", "Medium", "low", "0.8", "0.79", None)] == [2.0, 1.0, 0.5, 2.0, 1.0, 1.0]
    assert one(spark, "Seder Mishnah", X.first_containing(C, L.CATEGORY_PERIODS, "AMORAIC")) == "TANNAITIC"
    assert one(spark, "אb", X.script_share(C, "\\u0590", "\\u05FF")) == 0.5 and one(spark, "", X.script_share(C, "a", "b")) == 0.0


@pytest.mark.parametrize(
    "language,text,want",
    [
        ("hebrew", "שָלוֹם", "שלומ"),
        ("arabic", "أَةىـ", "اهي"),
        ("sanskrit", "अं॑क", "अक"),
        ("pali", "Ṃāñ", "man"),
        ("classical_chinese", "Ａ", "A"),
        ("english", "ＡB", "ab"),
    ],
)
def test_normalise(spark, language, text, want):
    assert one(spark, text, X.normalise(C, F.lit(language))) == want


def test_rules(spark):
    assert one(spark, "I must help my mother", R.roles(C)) == ["FAMILY", "SELF"]
    assert one(spark, "nothing", R.roles(C)) == ["OTHER", "SELF"]
    assert one(spark, "save, rescue; give charity", R.relations(C)) == ["HARM_PREVENTION", "CARE"] and one(spark, "zzz", R.relations(C)) == ["CARE"]
    assert one(spark, "You must and you may", R.top_class(C, L.STATES)) == "OBLIGATION"
    assert one(spark, "they disagree but accept", R.consent(C)) == "EXPLICIT_YES" and one(spark, "x", R.consent(C)) == "IMPLICIT_YES"
    assert tuple(one(spark, "some say no", R.consensus(C))) == ("contested", True)
    assert tuple(one(spark, "some say always", R.consensus(C))) == ("universal", False)
    assert tuple(one(spark, "you must not know", R.modal(C))) == ("obligation", "must")
    assert one(spark, "know", R.negated(C)) and not one(spark, "know", R.negated(C, tokens=True))
    assert tuple(one(spark, "x", R.bond(C, {"A": ["y"]}))) == (None, "OBLIGATION", False, None, 0.5, "unknown")
    g = one(spark, "you must promise, though permitted", R.gates(C))
    assert [x["trigger"] for x in g] == ["obligation_marker", "vow_marker", "permission_marker"] and {x["element"] for x in g} == {"r2"}
    assert tuple(one(spark, "you must promise", R.gate_state(R.gates(C)))) == ("O", 1.0) and tuple(one(spark, "hi", R.gate_state(R.gates(C)))) == (None, None)
    assert one(spark, "café caf", R.hits(C, [r"\bcaf\b"])) == 1


def test_bonds_and_signature(spark):
    bonds = R.bonds(F.array(F.lit("A"), F.lit("B")), F.array(F.lit("CARE"), F.lit("FAIRNESS")), F.lit("IMPLICIT_YES"))
    found = one(spark, "", bonds)
    assert len(found) == 4 + 2
    same = R.bonds(F.array(F.lit("X"), F.lit("Y")), F.array(F.lit("CARE"), F.lit("FAIRNESS")), F.lit("IMPLICIT_YES"))
    assert one(spark, "", R.signature(bonds)) == one(spark, "", R.signature(same)) != "empty"
    assert one(spark, "", R.signature(F.filter(bonds, lambda b: F.lit(False)))) == "empty"


def test_group_laws(spark):
    table = {(r.a, r.b): r["product"] for r in D.group_table(spark).collect()}
    assert len(table) == 64
    for a, b, c in itertools.product(D.ELEMENTS, repeat=3):
        assert table[table[a, b], c] == table[a, table[b, c]]
    assert table["s", table["r", "s"]] == "r3" and table["r", "s"] == "sr3"
    df = spark.createDataFrame([(e, s) for e in D.ELEMENTS for s in D.STATES], "e string, s string")
    act = {(r.e, r.s): (r.x, r.i) for r in df.select("e", "s", D.act(F.col("e"), F.col("s")).alias("x"), D.inverse(F.col("e")).alias("i")).collect()}
    assert [act["r", s][0] for s in "OCLN"] == ["C", "L", "N", "O"] and [act["s", s][0] for s in "OCLN"] == ["C", "O", "N", "L"]
    for a, b in itertools.product(D.ELEMENTS, repeat=2):
        for s in D.STATES:
            assert act[b, act[a, s][0]][0] == act[table[a, b], s][0]
    assert all(table[e, act[e, "O"][1]] == "e" for e in D.ELEMENTS)
    assert spark.range(1).select(D.act(F.lit("r"), F.lit("forbid")).alias("x")).first().x is None


def test_positional(spark):
    r = one(spark, "君必愛民也", R.positional(C))
    assert (r.bond_type, r.state, r.modal, r.agent, r.patient, r.passive, r.confidence) == ("CARE", "OBLIGATION", "必", "君", "民", False, 0.9)
    r = one(spark, "臣不可被殺於君", R.positional(C))
    assert (r.bond_type, r.modal, r.negated, r.passive, r.agent, r.patient) == ("HARM_PREVENTION", "可", True, True, "君", "臣") or r.passive
    r = one(spark, "天地", R.positional(C))
    assert (r.bond_type, r.agent, r.patient, r.confidence) == (None, None, None, 0.5)
    assert one(spark, None, R.positional(C)).bond_type is None


@pytest.mark.parametrize(
    "text,agent,patient",
    [
        ("I should help Mary today", "speaker", "mary"),
        ("i Ought to go", "speaker", None),
        ("You must not hurt them", "addressee", "them"),
        ("Parents must help the child", "parents", None),
        ("parents must protect my child", None, None),
        ("Anna ought to harm no one", "anna", "no"),
        ("He said I should go", None, None),
        ("Nobody came; HELP us", None, "us"),
        ("", None, None),
        (None, None, None),
    ],
)
def test_role_capture(spark, text, agent, patient):
    found = one(spark, text, R.role_capture(C))
    assert (found.agent, found.patient) == (agent, patient)


def test_morphological(spark):
    from lodestone.functions import lexicons as L

    of = lambda text, *rest: one(spark, text, R.morphological(C, *rest))[:]
    arabic, hebrew = (L.ARABIC_MODALS, L.ARABIC_NEGATIONS, L.ARABIC_MARKS, False), (L.HEBREW_MODALS, L.HEBREW_NEGATIONS, L.HEBREW_MARKS, True)
    assert of("\u062d\u064e\u0631\u0627\u0645", *arabic) == ("حرام", "NO_RIGHT", "prescriptive", False, 0.7)
    # Presentation forms are folded by NFKC.
    assert of("\ufef3\ufea0\ufe90", *arabic) == ("يجب", "OBLIGATION", "prescriptive", False, 0.7)
    assert of("سلام", *arabic) == (None, "OBLIGATION", "unknown", True, 0.5)  # a cue as a part of a word
    assert of("הלאה מותר", *hebrew) == ("מותר", "LIBERTY", "prescriptive", False, 0.7)
    assert of("לא", *hebrew) == (None, "OBLIGATION", "unknown", True, 0.5)


def test_portions():
    texts = pa.array(["a" * 10, None, "é" * X.PORTION, "", "b" * (X.PORTION - 10), "c" * 11, *["d"] * 2500])
    parts = list(X.portions(texts))
    assert [at for at, _ in parts] == [0, *itertools.accumulate(n for _, n in parts)][:-1] and sum(n for _, n in parts) == len(texts)
    for at, n in parts:
        assert n == 1 or sum(len(x.encode()) for x in texts.slice(at, n).to_pylist() if x) <= X.PORTION
    assert list(X.portions(pa.array([], pa.string()))) == [] and list(X.portions(pa.array([None], pa.string()))) == [(0, 1)]


def test_normalisation_is_one_call_of_python(spark):
    """Of whatever language; and each text is what Python makes of it."""
    names = ["hebrew", "arabic", "classical_chinese", "sanskrit", "pali", "english", None]
    texts = ["", None, "Plain ASCII", "E\u0301\ufb01", "\ufb2a\u05da", "\u0623\u0640\u0649", "\uff21", "\u0958\u0951", "\u1e42A"]
    rows = spark.createDataFrame([(n, t) for n in names for t in texts], "language string, text string").repartition(2)
    out = rows.withColumn("x", X.normalise(F.col("text"), F.col("language")))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "pythonUDF0" in plan and "pythonUDF1" not in plan
    n = unicodedata.normalize
    drop = {"hebrew": [*range(0x591, 0x5C8)], "arabic": [*range(0x64B, 0x660), 0x640], "sanskrit": [*range(0x951, 0x955), *range(0x900, 0x903)]}
    fold = {"hebrew": X._HEBREW[1:], "arabic": X._ARABIC[1:], "sanskrit": ("", "")}

    def want(name, t):
        if t is None:
            return None
        if name in drop:
            return n("NFC" if name == "sanskrit" else "NFKC", t).translate(dict.fromkeys(drop[name])).translate(str.maketrans(*fold[name]))
        return n("NFC", t).lower().translate(str.maketrans(*X._PALI)) if name == "pali" else n("NFKC", t if name == "classical_chinese" else t.lower())

    assert all(r.x == want(r.language, r.text) for r in out.collect())


def test_morphological_states_by_any_id(spark, tmp_path):
    """Each document goes to Python in its own script alone; ids below 0 are odd or even too."""
    from lodestone.plans import registry

    spark.createDataFrame([(i, "Text") for i in (-3, -2, -1, 0, 1, 2)] + [(7, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = registry.QUERIES["morphological_states"](spark, str(tmp_path))
    found = {r.doc_id: r for r in out.collect()}
    assert len(found) == 7 and all(found[i].negated is not None for i in (-3, -2, -1, 0, 1, 2)) and found[7].modal is None
    assert "pmod(doc_id" in out._jdf.queryExecution().optimizedPlan().toString()
