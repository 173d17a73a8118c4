"""Answers as texts, reactions against their draws, corpora by configuration."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import reactions
from lodestone.sources import corpora, responses

FENCE = "```"


def test_answers(spark):
    verdict = {"party_name": "anna", "classification": "O", "confidence": 0.9, "primary_dimension": "HARM", "reasoning": "r"}
    bare = {"party_name": "Zed", "classification": "N"}
    good = json.dumps({"verdicts": [verdict, bare], "advice": "talk", "ethical_dimensions": {"HARM": 0.5}})
    rows = {
        1: good, 2: f" {FENCE}json\n{good}\n{FENCE} rest", 3: f"{FENCE}\n{good}", 4: good[:-1], 5: None, 6: "", 7: json.dumps({"advice": "only"}), 8: json.dumps({"verdicts": [verdict, {"party_name": "Zed"}]}),
        9: json.dumps({"verdicts": [{"party_name": "Zed", "classification": "forbid"}]}), 10: json.dumps({"verdicts": [{"classification": "O"}]}), 11: "[1, 2]", 12: FENCE, 13: "no json at all", 14: json.dumps({"verdicts": []}),
    }
    parties = "array(named_struct('name', 'Anna', 'expected_state', 'O'), named_struct('name', 'ANNA', 'expected_state', 'C'), named_struct('name', 'zed', 'expected_state', cast(null as string)))"
    df = spark.createDataFrame(list(rows.items()), "id int, text string")
    got = {r.id: r.p for r in df.select("id", responses.parsed(F.col("text"), F.expr(parties)).alias("p")).collect()}
    for i in (1, 2, 3):
        first, second = got[i].verdicts
        assert not got[i].failed and got[i].advice == "talk" and got[i].ethical_dimensions == {"HARM": 0.5}
        assert tuple(first) == ("anna", "O", "O", True, 0.9, "HARM", "r") and tuple(second) == ("Zed", "N", None, None, 0.5, "UNKNOWN", "")
    for i in (4, 5, 6, 8, 9, 10, 11, 12, 13):
        assert got[i].failed and got[i].verdicts == [] and got[i].advice == "" and got[i].ethical_dimensions is None, i
    assert not got[7].failed and got[7].verdicts == [] and got[7].advice == "only"
    assert not got[14].failed and got[14].advice == ""


def test_reactions(spark):
    u = lambda i, salt: int(hashlib.md5(f"{i}:{salt}".encode()).hexdigest()[:8], 16) / 2**32
    outcomes = {"grateful": ["a", "b"], "neutral": ["c"]}
    verdicts = F.expr("CASE id % 3 WHEN 0 THEN array(named_struct('state', 'O', 'expected', 'O'), named_struct('state', 'C', 'expected', cast(null as string))) WHEN 1 THEN array(named_struct('state', 'O', 'expected', 'C')) ELSE array() END")
    rows = spark.range(600).select("id", reactions.follow_up(F.col("id"), verdicts, outcomes).alias("f"), reactions.engagement(F.col("id")).alias("e")).collect()
    for r in rows:
        mood = "neutral" if r.id % 3 == 1 else "grateful"
        assert (r.f is not None) == (u(r.id, "follow-up") < 0.3)
        if r.f:
            assert r.f.satisfaction == mood and r.f.outcome == outcomes[mood][int(u(r.id, "outcome") * len(outcomes[mood]))]
        assert 200 <= r.e.comments <= 2000 and r.e.comments // 2 <= r.e.shares <= r.e.comments * 3 and 50 <= r.e.saves <= 500
    assert 130 < sum(r.f is not None for r in rows) < 230


def test_corpora(spark):
    table = spark.createDataFrame([(i, f"text {i}", "ab"[i % 2]) for i in range(50)], "k int, t string, c string")
    own = {"table": "x", "id": "k", "text": "t"}
    config = {"corpora": {"one": {**own, "enabled": True, "category": "c", "periods": {"a": "OLD"}}, "off": {**own, "enabled": False}, "unsaid": own, "empty": None, "few": {**own, "enabled": True, "max_samples": 7}}}
    assert list(corpora.enabled(config)) == ["one", "few"]
    out = corpora.union(config, lambda name: {"x": table}[name]).collect()
    assert [sum(r.corpus == c for r in out) for c in ("one", "few", "off")] == [50, 7, 0]
    assert {(r.id, r.period) for r in out if r.corpus == "one" and int(r.id) < 2} == {("0", "OLD"), ("1", "UNKNOWN")}
    with pytest.raises(ValueError, match="no corpus"):
        corpora.union({"corpora": {}}, lambda name: table)
