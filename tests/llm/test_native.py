import hashlib
import re
from collections import Counter

from lodestone.llm.exact_dedup import exact_dedup
from lodestone.llm.line_dedup import line_dedup
from lodestone.llm.url_filter import RULES, url_filter

from .conftest import edge_rows

WHITE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_exact_dedup(spark, edge, empty):
    rows = edge_rows()
    for keep, pick in (("largest", max), ("smallest", min)):
        groups = {}
        for i, x in rows:
            groups.setdefault(x or "", []).append(i)
        best = {x: pick([i for i in ids if i is not None], default=None) for x, ids in groups.items()}
        want = sorted(((i, best[x or ""], len(groups[x or ""]), i == best[x or ""], hashlib.sha256((x or "").encode()).hexdigest()) for i, x in rows), key=str)
        assert sorted(map(tuple, exact_dedup(edge, keep=keep).collect()), key=str) == want
    assert exact_dedup(empty).count() == 0


def test_exact_dedup_compares_bytes(spark):
    """Texts of one hash group stay apart: the grouping has the text itself as a key."""
    plan = exact_dedup(spark.createDataFrame([(1, "a")], "doc_id int, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[h#\d+, t#\d+\]", plan)


def brute_lines(rows, mode, least):
    key = lambda s: s.strip(WHITE).translate(LOWER)
    split = [(i, (x or "").split("\n")) for i, x in rows]
    docs = Counter(k for k, _ in {(key(s), i if i is not None else "\n".join(ls)) for i, ls in split for s in ls})
    bad = {k for k, n in docs.items() if n >= least and k}
    first = {}
    for i, ls in split:
        for p, s in enumerate(ls):
            place = (i is not None, i or 0, p)
            first[key(s)] = min(first.get(key(s), place), place)
    out = []
    for i, ls in split:
        kept = [s for p, s in enumerate(ls) if key(s) not in bad or (mode == "first" and (i is not None, i or 0, p) == first[key(s)])]
        out.append((i, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup(spark, edge, empty):
    for mode in ("all", "first"):
        got = line_dedup(edge, mode=mode, min_docs=10)
        assert [c for c in edge.columns if c != "n_lines"] + ["n_lines", "n_dropped", "keep_runs"] == got.columns
        want = sorted(brute_lines(edge_rows(), mode, 10), key=str)
        assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got.collect()), key=str) == want
        assert sum(w[2] for w in want) >= 13
    assert line_dedup(empty).count() == 0


def test_line_bitmap(spark):
    lines = [f"own {i}" for i in range(150)]
    lines[3] = lines[60] = lines[149] = "again"
    rows = [(1, "\n".join(lines)), (2, "again")]
    got = {r.doc_id: r for r in line_dedup(spark.createDataFrame(rows, "doc_id int, text string"), mode="all", min_docs=2).collect()}
    assert got[1].keep_runs == [3, 1, 56, 1, 88, 1] and got[2].keep_runs == [0, 1]
    assert got[2].text == "" and got[1].n_dropped == 3


def test_rows_of_one_id_are_one_document(spark):
    rows = [(1, "same\nx"), (1, "same\ny"), (1, "z\nsame"), (2, "same"), (None, "a\nsame"), (None, "b\nsame"), (None, "b\nsame")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    by = {n: {r.n_dropped for r in line_dedup(df, mode="all", min_docs=n).where("text <> ''").collect()} for n in (4, 5)}
    assert by == {4: {1}, 5: {0}}  # two ids, and two texts without one
    assert sorted(r.text for r in line_dedup(df, mode="first", min_docs=2).where("doc_id IS NOT NULL").collect()) == ["", "x", "y", "z"]


def test_a_line_of_most_documents(spark):
    rows = [(i, f"own {i}\nall hold this\nx{i % 3}") for i in range(400)]
    out = line_dedup(spark.createDataFrame(rows, "doc_id int, text string").repartition(7), mode="first", min_docs=10).orderBy("doc_id").collect()
    assert [r.n_dropped for r in out] == [0, 1, 1] + [2] * 397
    assert out[0].text == rows[0][1] and out[9].text == "own 9" and out[9].keep_runs == [1, 2]


def test_first_inside_document(spark):
    rows = [(1, "a\nA \nb\na"), (2, "b\nc")]
    got = {r.doc_id: r.text for r in line_dedup(spark.createDataFrame(rows, "doc_id int, text string"), mode="first", min_docs=1).collect()}
    assert got == {1: "a\nb", 2: "c"}


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://A.example.COM/en/x?y#z", "https://www.example.com/en/", "http://x.net/es/a", "http://net/fr/", "http://example.com", "ftp://x.org/es/", "http://notexample.com/en/1", "http://a.net/es", "http://u.com/#/en/", "http://b.example.com/en/q/r/"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(3, urls[3]), (None, urls[4])]
    got = url_filter(spark.createDataFrame(rows, "page_id int, url string"), RULES).collect()

    def want(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0].translate(LOWER)
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fits = [(len(r), r, v) for v, r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        best = max(fits, default=(0, None, "allow"))
        return host, path, best[1], best[2]

    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(tuple(r)[1:])
    for i, u in rows:
        assert want(u) in by[i]
    assert len(got) == len(rows)


def test_url_rules_without_slash(spark):
    rules = [("block", "a.com/en/pri"), ("allow", "a.com/en/private/ok"), ("block", "com/")]
    rows = [(1, "http://a.com/en/price"), (2, "http://x.a.com/en/private/ok/1"), (3, "http://b.com/"), (4, "http://a.com/en/p")]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter(spark.createDataFrame(rows, "page_id int, url string"), rules).collect()}
    assert got == {1: ("a.com/en/pri", "block"), 2: ("a.com/en/private/ok", "allow"), 3: ("com/", "block"), 4: ("com/", "block")}


def test_url_edges(spark, edge, empty):
    assert url_filter(empty.withColumn("url", empty.text), RULES).count() == 0
    long = "http://" + ".".join("abcdefgh") * 300 + ".net/fr/" + "/".join("x" * 3 for _ in range(20_000))
    df = spark.createDataFrame([(1, long, "h", "p", "r")], "page_id int, link string, host string, path string, rule string")
    got = url_filter(df, RULES, url_col="link").collect()
    assert [(r.page_id, r.rule, r.verdict) for r in got] == [(1, "net/fr/", "block")] and got[0].path.startswith("/fr/xxx/")
    assert {r.verdict for r in url_filter(df, [], url_col="link", default="block").collect()} == {"block"}
