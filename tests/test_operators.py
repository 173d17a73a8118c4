import json

import pytest
from pyspark.sql import functions as F

from lodestone.functions import vectors as V
from lodestone.functions import special
from lodestone.operators import flatten, judgement, perturb, splits, statistics
from lodestone.sources import readers, sinks
from lodestone.streaming import windows

V = "session string, case int, position int, state string, expected string"


@pytest.mark.parametrize(
    "verdicts,tau,want",
    [
        ([("O", "O"), ("C", "C")], 1.0, 0.0),
        ([("O", "C"), ("C", "O")], 1.0, 1.0),
        ([("O", "O"), ("C", "O")], 1.0, 0.5),
        ([], 1.0, 0.0),
        ([("O", None)], 1.0, 0.0),
        ([("O", "C"), ("C", "O")], 2.0, 0.5),
    ],
)
def test_bond_index(spark, verdicts, tau, want):
    df = spark.createDataFrame([("s", 1, i, a, b) for i, (a, b) in enumerate(verdicts)], V)
    assert judgement.bond_index(df, [], tau).first()["bond_index"] == want


def test_accuracy(spark):
    df = spark.createDataFrame([("s", 1, 0, "O", "O"), ("s", 2, 0, "C", "C"), ("s", 3, 0, "L", "O")], V)
    assert judgement.accuracy(df, ["session"], "case").first()["accuracy_per_trial"] == pytest.approx(2 / 3)


def test_correlative_symmetry(spark):
    df = spark.createDataFrame([("s", 1, 0, "O", None), ("s", 1, 1, "C", None), ("s", 1, 2, "L", None), ("s", 2, 0, "N", None)], V)
    r = judgement.correlative_symmetry(judgement.correlative_pairs(df, "case", "position")).first()
    assert (r.o_c_pairs, r.o_c_violations, r.l_n_pairs, r.l_n_rate) == (3, 2, 0, 1.0) and r.bond_index == pytest.approx(2 / 3)
    empty = judgement.correlative_symmetry(judgement.correlative_pairs(df.limit(0), "case", "position")).first()
    assert (empty.o_c_rate, empty.bond_index) == (1.0, 0.0)


def test_first_seen_wins(spark):
    df = spark.createDataFrame([("g", "a", 1), ("g", "b", 2), ("g", "b", 3), ("g", "a", 4)], "gate string, v string, ordinal int")
    assert judgement.modal_value(df, ["gate"], "v", "ordinal", "m").first()["m"] == "a"


def test_macro_f1(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (2, 2), (1, 0)], "t int, p int")
    r = judgement.macro_f1(df, "t", "p").first()
    assert r.macro_f1 == pytest.approx((0.5 + 0 + 1) / 3) and r.accuracy == 0.5


def test_splits_are_disjoint_complete_and_stable(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") % 7).alias("g"))
    shares = [("train", 0.7), ("valid", 0.15), ("test", 0.15)]
    a = {r.doc_id: r.role for r in splits.by_shares(df.repartition(7), shares, "doc_id").collect()}
    b = {r.doc_id: r.role for r in splits.by_shares(df.coalesce(1), shares, "doc_id").collect()}
    assert a == b and len(a) == 1000 and [list(a.values()).count(s) for s, _ in shares] == [700, 150, 150]
    strata = splits.by_shares(df, shares, "doc_id", strata=["g"]).groupBy("g", "role").count().collect()
    assert {(r.g, r["count"]) for r in strata if r.role == "train"} == {(g, int(0.7 * (143 if g < 6 else 142))) for g in range(7)}
    assert splits.by_shares(df.limit(0), shares, "doc_id").count() == 0
    train, test = splits.without_overlap(df.where("doc_id < 10"), df.where("doc_id > 5"), "doc_id")
    assert train.count() == 6 and test.where("doc_id < 10").count() == 0


def test_leave_one_out(spark):
    df = spark.range(300).select(F.col("id"), F.when(F.col("id") < 150, "a").when(F.col("id") < 290, "b").otherwise("c").alias("era"))
    out = splits.leave_one_out(df, "era", "id").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("role") == "test").alias("t")).collect()
    assert {(r.split, r.n, r.t) for r in out} == {("a", 300, 150), ("b", 300, 140)}


def test_flatten(spark):
    rows = [(1, json.dumps([["a", "b"], ["c", ["d"]]]), json.dumps([["A", "B", "x"], ["C", ["D"]]])), (2, json.dumps(["only"]), None), (3, None, None)]
    df = spark.createDataFrame(rows, "id int, he string, en string")
    got = [tuple(r) for r in flatten.flatten_pairs(df, "he", "en", "id").orderBy("id", "path").collect()]
    assert got == [(1, "1.1", "a", "A"), (1, "1.2", "b", "B"), (1, "2.1", "c", "C"), (1, "2.2.1", "d", "D"), (2, "1", "only", None)]
    doc = json.dumps({"text": ["x" * 30, {"he": ["y" * 30, "short"]}], "other": "z" * 30})
    got = flatten.collect_texts(spark.createDataFrame([(1, doc), (2, None)], "id int, j string"), "j", "id").orderBy("ordinal").collect()
    assert [r.text[0] for r in got] == ["x", "y"]


def test_chunks(spark):
    text = " ".join(["word"] * 300)
    r = spark.createDataFrame([(text,), ("",)], "t string").select(flatten.chunks(F.col("t")).alias("c"), flatten.packed_paragraphs(F.col("t")).alias("p")).collect()
    assert all(400 <= len(c) < 406 for c in r[0].c[:-1]) and " ".join(r[0].c) == text and r[1].c == [] and r[1].p == []
    paragraphs = "\n\n".join(["a" * 700, "b" * 700, "c" * 2000, "d" * 10])
    got = spark.createDataFrame([(paragraphs,)], "t string").select(flatten.packed_paragraphs(F.col("t")).alias("p")).first().p
    assert [len(p) for p in got] == [1402, 2000, 10]


def test_chunks_of_long_texts(spark):
    df = spark.createDataFrame([(" ".join(["w" * 399] * 600 + ["end"]),)], "t string")
    r = df.select(flatten.chunks(F.col("t"), size=300).alias("all"), flatten.chunks(F.col("t"), size=300, most=500).alias("some")).first()
    assert len(r["all"]) == 600 and len(r.some) == 500
    short = spark.createDataFrame([("a " + "w" * 60,)], "t string")
    assert short.select(flatten.chunks(F.col("t"), size=1, most=1).alias("c")).first().c == []


def test_statistics(spark):
    df = spark.createDataFrame([(1.0, True), (2.0, True), (3.0, True), (2.0, False), (4.0, False), (6.0, False)], "v double, a boolean")
    u = statistics.mann_whitney(df, "v", F.col("a")).first()
    assert u.u == 1.5
    e = statistics.effect_size(statistics.two_samples(df, "v", F.col("a"))).first()
    assert e.cohens_d == pytest.approx(-2 / ((2 * 2 / 3 + 2 * 8 / 3) / 4) ** 0.5)
    b = statistics.bootstrap(df.withColumn("id", F.monotonically_increasing_id()), "v", "id", 300).first()
    assert b.low < b.mean < b.high
    single = statistics.bootstrap(df.limit(1).withColumn("id", F.lit(1)), "v", "id", 10).first()
    assert single.low == single.mean == single.high == 1.0
    z = 1 - spark.range(1).select(special.normal_greater(F.lit(1.96)).alias("p")).first().p
    assert z == pytest.approx(0.9750021, abs=1e-6)


def test_extreme_labels(spark):
    rows = [("a", [1.0, 0.0]), ("b", [2.0, -3.0]), ("c", [-1.0, 5.0]), ("d", [2.0, 0.0])]
    table = spark.createDataFrame(rows, "label string, centroid array<double>")
    axes = [[1.0, 0.0], [0.6, 0.8]]
    got = {(r.component, r.side, r.place): (r.label, round(r.projection, 9)) for r in statistics.extreme_labels(table, "label", axes).collect()}
    want = {}
    for i, axis in enumerate(axes, 1):
        found = [(round(sum(x * y for x, y in zip(c, axis, strict=True)), 9), n) for n, c in rows]
        for side, sign in (("low", 1), ("high", -1)):
            for place, (p, n) in enumerate(sorted(found, key=lambda x: (sign * x[0], x[1]))[:2], 1):
                want[i, side, place] = (n, p)
    assert got == want
    assert statistics.extreme_labels(table.limit(0), "label", axes).count() == 0
    assert statistics.extreme_labels(table.limit(1), "label", axes).count() == 4


def test_perturb(spark):
    df = spark.createDataFrame([("The son must honor the father.",), ("She Helped and helped",), ("zz",)], "t string")
    got = df.select(perturb.structural(F.col("t")).alias("x")).collect()
    assert got[0].x["kind"] == "role_swap" and got[1].x["text"] == "She refused to help and helped" and got[2].x is None


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"trial_id": "1", "session_id": "s", "verdicts": [{"party_name": "p", "state": "O"}]}\n\nbroken\n')
    rows = readers.json_lines(spark, str(tmp_path / "in"), readers.TRIALS).collect()
    assert len(rows) == 2 and sum(r._corrupt is not None for r in rows) == 1
    (tmp_path / "x.csv").write_text('Year,Question\n1990,"a\nb"\n')
    r = readers.csv_any(spark, str(tmp_path / "x.csv"), {"date": ["date", "year"], "question": ["question"], "answer": ["answer"]}).first()
    assert (r.date, r.question, r.answer) == ("1990", "a\nb", None)
    (tmp_path / "q.txt").write_text("1|2|text | more\n\n")
    assert [tuple(r) for r in readers.delimited(spark, str(tmp_path / "q.txt"), ["s", "a", "t"]).collect()] == [("1", "2", "text | more")]
    (tmp_path / "l.json").write_text('{"letters": [{"id": "1"}, {"id": "2"}]}')
    assert readers.json_documents(spark, str(tmp_path / "l.json"), "struct<id:string>").count() == 2
    (tmp_path / "tree/T/Avot").mkdir(parents=True)
    for n in ("merged.json", "v1.json"):
        (tmp_path / "tree/T/Avot" / n).write_text("{}")
    r = readers.tree(spark, str(tmp_path / "tree")).collect()
    assert [(x.category, x.source) for x in r] == [("T", "Avot")] and r[0].path.endswith("merged.json")
    assert [(r.ordinal, r.value) for r in readers.lines(spark, str(tmp_path / "q.txt")).collect()][0] == (1, "1|2|text | more")
    sinks.chunked(spark.range(1200), str(tmp_path / "out"), 500)
    assert spark.read.json(str(tmp_path / "out")).count() == 1200
    sinks.by_key(spark.range(10).withColumn("m", F.col("id") % 2), str(tmp_path / "k"), ["m"])
    assert spark.read.parquet(str(tmp_path / "k")).where("m = 1").count() == 5
    assert readers.snapshot(spark, str(tmp_path / "k"), lambda: None, ["m", "id"]).count() == 10
    assert readers.snapshot(spark, str(tmp_path / "new"), lambda: spark.range(3), ["id"]).count() == 3


def test_tar_and_tags(spark, tmp_path):
    import io
    import tarfile

    with tarfile.open(tmp_path / "a.tar", "w") as tar:
        for name, data in (("d/x.csv", b"1,2"), ("d/y.txt", b"no")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    assert [(r.member, r.value) for r in readers.tar_members(spark, str(tmp_path / "a.tar"), ".csv").collect()] == [("d/x.csv", "1,2")]
    df = spark.createDataFrame([("<seg id='1'>a\nb</seg><seg>c</seg>",)], "t string")
    assert df.select(readers.segments(F.col("t")).alias("s")).first().s == ["a\nb", "c"]


def test_stream_gives_the_batch_result(spark, tmp_path):
    path = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(path)
    stream = spark.readStream.schema(batch.schema).parquet("/root/testdata/sf0.001", pathGlobFilter="events.parquet")
    got = windows.run_to_table(windows.windowed_index(windows.judged(stream)), "hourly", str(tmp_path / "c"), "complete")
    want = windows.windowed_index(windows.judged(batch))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    stream = spark.readStream.schema(batch.schema).parquet("/root/testdata/sf0.001", pathGlobFilter="events.parquet")
    trials = windows.run_to_table(windows.first_trials(windows.judged(stream)), "trials", str(tmp_path / "d"))
    assert trials.count() == batch.count()


def test_nearest(spark):
    """Ties go to the smaller label, repeated ids stay, and a row whose only label is its own has none."""
    table = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])], "label int, centroid array<double>")
    df = spark.createDataFrame([("x", 1, [2.0, 0.1]), ("x", 1, [2.0, 0.1]), ("y", 3, [3.0, 0.0]), ("z", None, [0.0, 5.0])], "id string, own int, v array<double>")
    assert sorted((r.id, r.label) for r in statistics.nearest(df, "v", "id", table, "label").collect()) == [("x", 1), ("x", 1), ("y", 1), ("z", 2)]
    own = statistics.nearest(df, "v", "id", table, "label", F.col("own"))
    assert sorted((r.id, r.label) for r in own.collect() if r.id != "z") == [("x", 3), ("x", 3), ("y", 1)]
    alone = statistics.nearest(df.where("id = 'y'"), "v", "id", table.where("label = 3"), "label", F.col("own")).first()
    assert (alone.label, alone.distance) == (None, None)
    assert statistics.nearest(df.limit(0), "v", "id", table, "label").count() == 0


def test_numbered(spark):
    df = spark.createDataFrame([({"10": "j", "2": "b", "x": "no"},)], "m map<string, string>")
    assert [(r.number, r.value) for r in readers.numbered(df, "m").collect()] == [(2, "b"), (10, "j")]
    assert readers.numbered(df.limit(0), "m").count() == 0


def test_read_lexicon(spark, tmp_path):
    entries = [("he", "OATH", 1, "b"), ("en", "CARE", 0, "help"), ("he", "OATH", 0, "a"), ("he", "HARM", 2, "c")]
    (tmp_path / "lexicon.jsonl").write_text("\n".join(json.dumps({"language": g, "kind": "bond", "class": c, "ordinal": o, "pattern": x}) for g, c, o, x in entries))
    assert readers.read_lexicon(spark, str(tmp_path)) == {"en": {"CARE": ["help"]}, "he": {"OATH": ["a", "b"], "HARM": ["c"]}}


def test_scratch_of_failing_blocks_and_threads(spark):
    """A block that fails leaves nothing; what is kept goes to the block around; threads don't see each other's tables."""
    import os
    import threading

    from lodestone.session import materialize, scratch

    folder = lambda df: df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    with scratch(spark) as keep_outer:
        try:
            with scratch(spark):
                gone = folder(materialize(spark.range(3), "gone"))
                raise ValueError("stage fails")
        except ValueError:
            assert not os.path.exists(gone)
        with scratch(spark) as keep:
            inner = materialize(spark.range(3), "inner")
            keep(inner)
        assert inner.count() == 3
        at = folder(inner)
        other: list = []
        thread = threading.Thread(target=lambda: other.append(materialize(spark.range(5), "other")))
        thread.start()
        thread.join()
        kept = materialize(spark.range(4), "kept")
        keep_outer(kept)
    assert not os.path.exists(at)
    assert kept.count() == 4 and other[0].count() == 5


def test_battery_takes_the_vector_of_a_text_once(spark):
    """However many variants a text has; none for a variant that is the text itself."""
    from lodestone.operators import perturb

    asked = spark.sparkContext.accumulator(0)

    def lengths(text):
        asked.add(1)
        return [float(len(text or "")), 1.0]

    vector = F.udf(lengths, "array<double>")
    texts = spark.createDataFrame([(1, "b of the a"), (2, "of a"), (3, "x"), (4, None)], "id int, text string")
    out = perturb.battery(texts, "id", "text", {"k": [(" the ", " "), ("of", "from")]}, {"b": "c"}, ["d", "e"], vector)
    found = sorted((r.id, r.structural, r.kind) for r in out.collect())
    assert found == [(1, False, "detail"), (1, False, "detail"), (1, False, "name_change"), (1, True, "k"), (1, True, "k"), (2, False, "detail"), (2, False, "detail"), (2, True, "k"), (3, False, "detail"), (3, False, "detail")]
    assert asked.value == len(found) + 4


def test_battery_adds_the_vectors_of_details(spark):
    """A text is not gone through again for a detail behind it; the rows are those of the vectors of whole texts."""
    from lodestone.functions import vectors as V
    from lodestone.operators import perturb

    texts = spark.createDataFrame([(1, "b of the a"), (2, "of  a\n"), (3, "x"), (4, None), (5, ""), (6, " ")], "id int, text string")
    args = (texts, "id", "text", {"k": [(" the ", " "), ("of", "from")]}, {"b": "c"}, ["d", "e f"])
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(perturb.battery(*args, V.hashed_words, V.add)) == rows(perturb.battery(*args, V.hashed_words))
    asked = spark.sparkContext.accumulator(0)

    def lengths(text):
        if text not in (None, "d", "e f"):
            asked.add(1)
        return None if text is None else [float(len(text)), 1.0]

    out = perturb.battery(*args, F.udf(lengths, "array<double>"), V.add).collect()
    assert len(out) == 4 + 2 * 5 and asked.value == 5 + 4


def test_hashed_words(spark):
    import hashlib

    from lodestone.functions.vectors import hashed_words

    texts = ["", "  ", "a", "the of the\n of\tthe", None, "é 0 f " * 50]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", hashed_words(F.col("t")).alias("v")).collect()
    for r in got:
        digits = [hashlib.md5(w.encode()).hexdigest()[0] for w in (r.t or "").split()]
        assert r.v == ([None] * 16 if r.t is None else [float(digits.count(d)) for d in "0123456789abcdef"])
