import importlib.util

import pytest

from lodestone.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def test_one_query_an_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_stages(spark):
    if importlib.util.find_spec("corpus_pipeline") is None:
        pytest.skip("without the pipeline")
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    from lodestone.session import materialize

    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns
        assert 0 < docs.count() <= before
        before = docs.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_run(spark):
    """Every document that the stages keep is in the windows once, gapless, and no window is longer than 4096 tokens."""
    if importlib.util.find_spec("corpus_pipeline") is None:
        pytest.skip("without the pipeline")
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF).collect()
    ids = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert {r.doc_id for r in rows} < ids
    ends, size = {}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == ends.get(r.doc_id, 0)
        ends[r.doc_id] = r.start + r.length
        size[r.sequence_id] = size.get(r.sequence_id, 0) + r.length
    assert max(size.values()) <= 4096 and all(ends[r.doc_id] == r.doc_tokens for r in rows)


COLUMNS = {
    "op1_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op2_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op3_quality_crf": ["doc_id", "held_out", "score", "predicted"],
    "op4_line_dedup": ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
    "op5_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op6_url_filter": ["page_id", "host", "path", "rule", "verdict"],
    "op7_media_jpeg": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
    "op8_sentencepiece": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op9_jaccard_join": ["doc_id", "n_shingles", "component_id"],
    "op10_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op11_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op12_centroid_clustering": ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
    "op13_importance_resampling": ["doc_id", "n_features", "weight", "score", "rank"],
}
LIMIT = {"op3_quality_crf": 0.7, "op10_toxicity": 0.3}


@pytest.mark.parametrize("name", COLUMNS)
def test_registered_queries(spark, name):
    """The queries themselves: columns of the contract, one row a document (packing aside), folds and thresholds."""
    import zlib

    out = QUERIES[name](spark, SF)
    assert out.columns[: len(COLUMNS[name])] == COLUMNS[name]
    rows = out.collect()
    table = {"op6_url_filter": "pages", "op12_centroid_clustering": "embeddings"}.get(name, "documents")
    key = out.columns[0]
    want = sorted(r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect())
    assert sorted({r[0] for r in rows} if name == "op5_packing" else [r[0] for r in rows]) == want
    if name in LIMIT:
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= LIMIT[name]) for r in rows)
        labels = {r.doc_id: r[1] for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality" if name == "op3_quality_crf" else "toxic").collect()}
        judged = [r.predicted == labels[r.doc_id] for r in rows if r.held_out and labels.get(r.doc_id) is not None]
        assert sum(judged) >= 0.8 * len(judged)
    if name == "op7_media_jpeg":
        assert all(r.payload_bytes % 64 == 0 and r.payload_bytes >= max(r.n_bytes, 64) for r in rows)
    if name == "op1_suffix_dedup":
        assert any(0 < r.n_removed < r.n_bytes for r in rows) and any(not r.n_removed for r in rows)


def corpus_rows():
    """Documents with nulls, repeated rows and ids, empty and long texts, copies, near copies, shared lines and passages; a few of them are toxic."""
    import random

    from .conftest import edge_rows, sentence

    rng = random.Random(17)
    rows = [(i, x[:20_000] if x else x) for i, x in edge_rows()]
    rows += [(200 + i, sentence(rng, rng.randrange(30, 90))) for i in range(60)]
    rows += [(300 + i, f"{sentence(rng, 12)} idiot clown {sentence(rng, 5)} stupid idiot loser") for i in range(20)]
    return rows


def write_tables(spark, folder, rows):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, n_lines string, rid bigint, region string, component_id bigint"
    table = [(i, x, "en", f"src{(i or 0) % 3}", None if x is None else len(x), 0.5, "clash", 7, "r", None) for i, x in rows]
    spark.createDataFrame(table, schema).repartition(4).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(i >= 300)) for i, _ in rows if i is not None and i >= 200]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def brute_near(rows, width=5, percent=80):
    """The rows that stay: all whose id is the smallest of its component, and those without an id."""
    import re

    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, x in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", (x or "").translate(low))
        sets.append({tuple(ws[j : j + width]) for j in range(len(ws) - width + 1)} if len(ws) >= width else {tuple(ws)} if ws else set())
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            same = rows[a][0] is not None and rows[a][0] == rows[b][0] and sets[a] and sets[b]
            if same or (sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])):
                root[find(b)] = find(a)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None and sets[k]:
            least[find(k)] = min(least.get(find(k), i), i)
    gone = {i for k, (i, _) in enumerate(rows) if i is not None and sets[k] and least[find(k)] != i}
    return [r for r in rows if r[0] not in gone]


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage at its own parameters on what its predecessor kept; columns of any name stay, and no clean document goes."""
    if importlib.util.find_spec("corpus_pipeline") is None:
        pytest.skip("without the pipeline")
    import corpus_pipeline
    from lodestone.session import materialize

    from .test_native import brute_lines
    from .test_texts import brute_repeats

    folder = str(tmp_path / "in")
    write_tables(spark, folder, corpus_rows())
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, of = docs.columns, lambda df: sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)
    stages = dict(corpus_pipeline.STAGES)
    before = of(docs)
    clean = materialize(stages["toxicity"](spark, docs, folder), "test-toxicity")
    after = of(clean)
    assert clean.columns == columns and set(after) <= set(before)
    assert not {i for i, _ in after if i is not None and i >= 300} and {i for i, _ in before if i is not None and 200 <= i < 300} <= {i for i, _ in after}
    lines = materialize(stages["line_dedup"](spark, clean, folder), "test-lines")
    null = {i for i, x in after if x is None}
    want = sorted(((i, None if x == "" and i in null and (i, None) in after else x) for i, _, _, x in brute_lines(after, "first", 10)), key=str)
    empty = lambda rows: sorted(((i, x or "") for i, x in rows), key=str)
    assert lines.columns == columns and empty(of(lines)) == empty(want)
    near = materialize(stages["jaccard_join"](spark, lines, folder), "test-near")
    assert near.columns == columns and of(near) == sorted(brute_near(of(lines)), key=str)
    cut = materialize(stages["suffix_dedup"](spark, near, folder), "test-cut")
    kept = of(near)
    texts = sorted(((i, w[4].decode(errors="ignore")) for (i, _), w in zip(kept, brute_repeats([(x or "").encode() for _, x in kept], 200), strict=True)), key=str)
    assert cut.columns == columns and empty(of(cut)) == empty(texts)
    assert all(r.n_chars is None if r.text is None else r.n_chars == len(r.text) for r in cut.collect())
    pieces = stages["packing"](spark, cut, folder).collect()
    assert sum(r.length for r in pieces if r.start == 0) <= sum(r.length for r in pieces)
    assert len([r for r in pieces if r.start == 0]) == cut.count()


def test_run_over_empty_tables(spark, tmp_path):
    if importlib.util.find_spec("corpus_pipeline") is None:
        pytest.skip("without the pipeline")
    import corpus_pipeline

    folder = str(tmp_path / "in")
    rows = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    rows.write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
