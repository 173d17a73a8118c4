"""Answers of a judge as texts: JSON, perhaps inside a code fence, read with defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.dihedral import STATES
from lodestone.functions.rules import let

ANSWER = "verdicts array<struct<party_name:string,classification:string,confidence:double,primary_dimension:string,reasoning:string>>, advice string, ethical_dimensions map<string,double>"
_FENCE = "```"


def unfenced(text: Column) -> Column:
    """What stands in the first code fence of a text that begins with one, without the word json; other texts as they are, trimmed."""
    x = F.trim(text)
    inner = F.coalesce(F.get(F.split(x, _FENCE), F.lit(1)), F.lit(""))
    return F.when(x.startswith(_FENCE), F.when(inner.startswith("json"), F.substr(inner, F.lit(5))).otherwise(inner)).otherwise(x)


def parsed(text: Column, parties: Column) -> Column:
    """struct<failed, verdicts, advice, ethical_dimensions> of an answer.

    parties: array<struct<name, expected_state>>; a verdict has the expectation of the first party of its name, whatever the case, and correct is null where there is none. A missing confidence is 0.5, a missing
    dimension "UNKNOWN", other missing texts are empty. An answer that is no JSON object, or one of whose verdicts lacks its party or has a state other than O, C, L and N, has failed as a
    whole: no verdicts, an empty advice and no dimensions. A null answer has failed.
    """

    def verdict(v: Column) -> Column:
        same = F.filter(parties, lambda p: F.lower(p["name"]) == F.lower(v["party_name"]))
        expected = F.get(same, F.lit(0))["expected_state"]
        return F.struct(
            v["party_name"].alias("party_name"),
            v["classification"].alias("classification"),
            expected.alias("expected"),
            (v["classification"] == expected).alias("correct"),
            F.coalesce(v["confidence"], F.lit(0.5)).alias("confidence"),
            F.coalesce(v["primary_dimension"], F.lit("UNKNOWN")).alias("primary_dimension"),
            F.coalesce(v["reasoning"], F.lit("")).alias("reasoning"),
        )

    def of(body: Column) -> Column:
        return let(F.from_json(body, ANSWER), lambda j: answer(body, j))

    def answer(body: Column, j: Column) -> Column:
        verdicts = F.coalesce(j["verdicts"], F.array().cast("array<struct<party_name:string,classification:string,confidence:double,primary_dimension:string,reasoning:string>>"))
        wrong = F.exists(verdicts, lambda v: v["party_name"].isNull() | ~F.coalesce(v["classification"].isin(*STATES), F.lit(False)))
        failed = F.coalesce(F.json_object_keys(F.when(F.is_valid_utf8(body), body)).isNull() | wrong, F.lit(True))
        read = F.transform(verdicts, verdict)
        return F.struct(
            failed.alias("failed"),
            F.when(failed, F.filter(read, lambda v: F.lit(False))).otherwise(read).alias("verdicts"),
            F.when(failed, "").otherwise(F.coalesce(j["advice"], F.lit(""))).alias("advice"),
            F.when(~failed, j["ethical_dimensions"]).alias("ethical_dimensions"),
        )

    return let(unfenced(text), of)
