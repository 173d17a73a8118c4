"""Lexicon files, and the automaton against regular expressions one by one."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.functions import lexicons as L
from lodestone.functions import text as T
from lodestone.operators import automaton as A
from lodestone.sources import lexicons as X

OTHERS = [r"\bgive.*back", r"a.b", r"[ab]c", r"a.*b", r"(a|ab)(c|bc)", r"\bx\b", r"ab.*c.*d", r"x\.y", r"'s\b", r"\b-a", r"colou?r", r"rabbi \w+ says.*end", "פקוח.נפש"]
PATTERNS = [p.lower() for lexicon in (L.ROLES, L.RELATIONS, L.STATES, L.CONSENT) for ps in lexicon.values() for p in ps] + [p.lower() for p in L.DISPUTE + L.UNIVERSAL] + OTHERS


@pytest.mark.parametrize("seed", range(6))
def test_counts_are_those_of_regular_expressions(seed):
    rng = random.Random(seed)
    automaton = A.Patterns(PATTERNS)
    gaps = ["honor", "respect", "parent", "father", "give", "back", "sabbath", "save", "life", "support", "family", "child", "\n", "end"]
    words = [w for p in PATTERNS for w in re.findall(r"[a-z]{1,}", p) if len(w) < 12] + [*"abcdxy", "x.y", "é", "\n", "one's", "put to death", "rabbi joe says", "color", "colour", "פקוח נפש"]
    for k in range(500):
        of = gaps if k % 3 == 0 else words
        text = rng.choice(["", " "]) + "".join(rng.choice(of) + rng.choice([" ", "  ", "\n", "", "-", ".", "é"]) for _ in range(rng.randrange(60)))
        want = {n: c for n, p in enumerate(PATTERNS) if (c := sum(1 for _ in re.finditer(p, text)))}
        assert automaton.matches(text) == want, text


def test_choices_share_a_gap():
    """One match reaches to the last choice in the line, whichever that is."""
    automaton = A.Patterns([r"\b(honor|respect)\b.*\b(parent|father)\b"])
    assert automaton.matches("honor parent respect father") == {0: 1}
    assert automaton.matches("honor parent\nrespect father honor x") == {0: 2}
    assert automaton.matches("honor\nparent") == {}


def test_many_openings_of_a_gap_take_linear_time():
    assert A.Patterns([r"\bgive.*back"]).matches("give " * 300_000) == {}


def test_match_lexicon(spark):
    patterns = [("en", "bond", "CARE", r"\bhelp"), ("en", "bond", "CARE", r"\bkind"), ("en", "bond", "HARM", r"\bkill"), ("en", "state", "DUTY", r"\bmust\b"), ("xx", "bond", "OTHER", "o")]
    rows = [(1, "en", "kind people must kill, must help"), (2, "xx", "foo o"), (3, None, "help"), (4, "zz", "help"), (5, "en", None), (6, "en", "")]
    df = spark.createDataFrame(rows, "id int, matches string, text string").repartition(3)
    got = {r.id: r for r in A.match_lexicon(df.withColumnRenamed("matches", "language"), patterns, ["id", "language"], F.col("text"), "language").select(
        "id", "matches", A.classes(F.col("matches"), "bond", "NONE").alias("all"), A.first(F.col("matches"), "state").alias("state"), A.first_patterns(F.col("matches"), "bond").alias("firsts"), A.ranked(F.col("matches"), "bond", ["HARM", "CARE"]).alias("ranked")).collect()}
    assert [tuple(m) for m in got[1].matches] == [("bond", "CARE", r"\bhelp", 1, 28), ("bond", "CARE", r"\bkind", 1, 0), ("bond", "HARM", r"\bkill", 1, 17), ("state", "DUTY", r"\bmust\b", 2, 12)]
    assert got[1]["all"] == ["CARE", "HARM"] and got[1].state == "DUTY" and got[1].ranked == ["CARE", "HARM"]
    assert [tuple(x) for x in got[1].firsts] == [("CARE", r"\bhelp"), ("HARM", r"\bkill")]
    assert [tuple(m) for m in got[2].matches] == [("bond", "OTHER", "o", 3, 1)]
    assert all(got[i].matches == [] and got[i]["all"] == ["NONE"] and got[i].state is None for i in (3, 4, 5, 6))


def test_a_worker_holds_a_portion_of_a_batch():
    texts = ["help " * 150_000, None, "kill", "help " * 150_000, "x" * 3_000_000, "help kill"]
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(6)), "text": pa.array(texts)})
    out = list(A._matched([("", "bond", "CARE", r"\bhelp"), ("", "bond", "HARM", r"\bkill")], None, 1)([batch]))
    assert [b.num_rows for b in out] == [3, 1, 1, 1]
    found = {r["id"]: [(m["class"], m["n"]) for m in r["matches"]] for b in out for r in b.to_pylist()}
    assert found == {0: [("CARE", 150_000)], 1: [], 2: [("HARM", 1)], 3: [("CARE", 150_000)], 4: [], 5: [("CARE", 1), ("HARM", 1)]}


def test_bonds_take_one_call_of_python_for_normalisation(spark):
    pytest.importorskip("yaml")
    from lodestone.plans import registry

    plan = registry.QUERIES["lexicon_bonds"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "pythonUDF0" in plan and "pythonUDF1" not in plan


@pytest.mark.parametrize("name", ["lexicon_bonds", "lexicon_pattern_hits"])
def test_one_worker_normalises_and_matches(spark, name):
    """Texts go to Python once, and don't come back."""
    pytest.importorskip("yaml")
    from lodestone.plans import registry

    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "InArrow" not in plan


def test_lexicon_matches_are_those_of_normalised_texts(spark):
    patterns = [(n, "bond", "CARE", p) for n, p in [("english", r"\bkill"), ("hebrew", "שלומ"), ("arabic", "رحمه"), ("pali", "dana"), ("sanskrit", "धम"), ("classical_chinese", "仁")]]
    texts = ["KILL kill", "ﬁne kill", "שָׁלוֹם שלום", "رَحْمَة رحمة", "Dāna DĀNA dāna", "धंम धम", "仁 仁", "ΣΑΣ İ", "", None]
    rows = [(10 * i + k, n, x) for i, n in enumerate([*X.LANGUAGES, "other", None]) for k, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "id int, language string, text string").repartition(3)
    want = {r.id: r.matches for r in A.match_lexicon(df, patterns, ["id", "language"], T.normalise(F.col("text"), F.col("language")), "language").collect()}
    got = {r.id: r.matches for r in df.select("id", A.lexicon_matches(patterns, F.col("text"), F.col("language"), T.normalised).alias("matches")).collect()}
    assert got == want and len(got) == len(rows) and sum(m.n for ms in got.values() for m in ms) >= 10
    forms = {r.id: r.x for r in df.select("id", T.normalise(F.col("text"), F.col("language")).alias("x")).collect()}
    assert forms == {i: None if x is None else T.normalised(x, n) for i, n, x in rows}


def test_files(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text("bond_patterns:\n  latin:\n    CARE: ['\\bserv', noce]\n    ODD: [x]\n  greek:\nhohfeld_patterns:\n  latin:\n    RIGHT: [ius]\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.yml").write_text("bond_patterns:\n  greek:\n    CARE: [σώζω]\nother: 3\n")
    table = X.read_lexicons(spark, str(tmp_path))
    assert table.count() == 5
    assert [tuple(r) for r in X.unknown(table).collect()] == [("latin", "bond", "ODD", 1)]
    with pytest.warns(UserWarning, match="ODD"):
        rows = X.loaded(table)
    assert rows == [("greek", "bond", "CARE", "σώζω"), ("latin", "bond", "CARE", r"\bserv"), ("latin", "bond", "CARE", "noce"), ("latin", "hohfeld", "RIGHT", "ius")]


def test_shipped(spark):
    pytest.importorskip("yaml")
    table = X.shipped(spark)
    assert {r.language for r in table.collect()} == set(X.LANGUAGES) and X.unknown(table).count() == 0
    one = X.loaded(X.shipped(spark, "english"))
    assert one[0] == ("english", "bond", "HARM_PREVENTION", r"\bkill") and {r[1] for r in one} == {"bond", "hohfeld", "negation", "modal", "context"}
