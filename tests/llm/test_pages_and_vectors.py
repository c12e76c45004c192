"""Archives, main text, vector searches, the registered queries and the pipeline."""

import time
import hashlib
import os

import corpus_pipeline
import duckdb
import numpy as np
import pytest

from tradeweft.llm import hamming, main_text, posting_lists, queries, warc

LONG = "é" * 40_000 + "\r\n" * 30 + "x" * 70_000 + "\r\n"
PAGES = [(-1, "u", "a\r\n\r\nWARC/1.1\r\n0\r\n\r\n"), (-2, None, None), (-3, "u", ""), (-4, "u", "\r\n"), (-5, "u", LONG), (-6, "u", LONG),
         (-8, "u\r\nX: y", "x" * 999), (-9, "u", "x" * 999), (-10, "u", "y" * 1000), (-11, "u", "y" * 1000), (-11, "u", "y" * 1000)]
PAGE_SCHEMA = "page_id long, url string, html string"
ARTICLE = """<html><body><header><h1>Site</h1><a href=/>Home</a></header><nav><a href=1>A</a></nav>
<div class="cookie-notice"><p>We use cookies here, accept them.</p></div><article><h1>The  title</h1>
<p>First paragraph &amp; more, with a good number of words in it so that it looks like text.</p><div class="ad">Buy things now.</div>
<p>Second paragraph, also quite long as an article of this kind has it.</article>
<section id="comments"><p>I liked this article very much, it is a good one.</p></section><script>var x = "<p>no</p>"</script>
<footer>Copyright</footer></body></html>"""


def test_archives_round_trip(spark):
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
           for r in warc.round_trip(spark.createDataFrame(PAGES, PAGE_SCHEMA)).collect()}
    first = {-6: -5, -11: -10}
    assert got == {i: (len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(),
                       "revisit" if i in first else "response", first.get(i)) for i, _, h in PAGES}
    assert warc.round_trip(spark.createDataFrame([], PAGE_SCHEMA)).count() == 0


def test_chunks_are_bounded_and_carry_digests(spark, tmp_path):
    out = f"{spark.conf.get('spark.checkpoint.dir', None) or f'file://{tmp_path}'}/chunks-{os.getpid()}"
    warc.write_archives(spark.createDataFrame(PAGES, PAGE_SCHEMA), out)
    rows = sorted(warc.read_chunks(spark, out).where("page_id = -5").collect(), key=lambda r: r.chunk)
    assert len(rows) == 3 and max(len(r.data) for r in rows) <= warc.CHUNK
    so_far = b""
    for r in rows:
        so_far += bytes(r.data)
        assert (r.bytes_so_far, r.sha1_so_far) == (len(so_far), hashlib.sha1(so_far).hexdigest())
    assert so_far.decode() == LONG


def test_main_text_of_real_and_odd_pages(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    model = main_text.train(pages)
    odd = [(1, "u", ARTICLE), (2, None, None), (3, "", ""), (4, "u", "just words"), (5, "u", "<p>" * 3000 + "deep"), (6, "u", "<div><p>a</div></p></x>"),
           (7, "u", "<" * 100), (None, None, "<p>x")]
    got = {r.page_id: r for r in main_text.extract(spark.createDataFrame(odd, PAGE_SCHEMA), model).collect()}
    assert len(got) == 8 and got[2].text == got[3].text == "" and all(r.n_chars == len(r.text) for r in got.values())
    assert got[1].text.split("\n") == ["The title", "First paragraph & more, with a good number of words in it so that it looks like text.",
                                       "Second paragraph, also quite long as an article of this kind has it."]
    assert main_text.extract(spark.createDataFrame([], PAGE_SCHEMA), None).count() == 0


def test_main_text_of_a_page_with_many_siblings(spark, small):
    model = main_text.train(spark.read.parquet(f"{small}/pages.parquet"))
    menu = "<nav><ul>" + "".join(f"<li><a href={i}>Part {i}</a></li>" for i in range(12)) + "</ul></nav>"
    said = [f"Paragraph {i} of the article, with a good number of words in it so that it looks like text." for i in range(300)]
    page = f"<html><body>{menu}<article>{''.join(f'<p>{t}</p>' for t in said)}</article>{menu}<footer>Copyright</footer></body></html>"
    got = main_text.extract(spark.createDataFrame([(1, "u", page)], PAGE_SCHEMA), model).first()
    assert got.text.split("\n") == said


def test_sibling_features_do_not_depend_on_the_number_of_siblings():
    for n in (150, 300):
        nodes = main_text.in_order(main_text.parse("<p>one two</p><div>x</div>" * (n // 2)))
        own = main_text.features(nodes)[[i for i, node in enumerate(nodes) if node.parent is nodes[0]]]
        assert np.allclose(own[:, 10], np.arange(n) / n) and np.allclose(own[:, 11], 0.5)
        assert own[0, 15] == -1 and own[1:5, 15].tolist() == [7, 1, 7, 1]


@pytest.mark.parametrize("before", ["<button>Menu", "<svg><path d=1>", "<header><button>Menu</header>", "<button>A<button>B<select><option>c"])
def test_an_unclosed_button_does_not_drop_the_article(before):
    runs = lambda html: [n.text for n in main_text.in_order(main_text.parse(html)) if n.text]
    article = "<article><p>one</p><p>two <b>three</b></p></article><p>four</p>"
    assert runs(f"<html><body>{before}{article}</body></html>") == ["one", "two three", "four"]
    assert runs(f"{article}<div>five {before}<p>six</p></div>seven") == ["one", "two three", "four", "five", "six", "seven"]


def test_closed_buttons_and_nested_objects_are_dropped():
    runs = lambda html: [n.text for n in main_text.in_order(main_text.parse(html)) if n.text]
    assert runs("<p>a <button><p>x</p></button>b</p>c<object><object>y</object>z</object>d</svg>") == ["a b", "c d"]
    assert runs("<ul><li>a<button>x<li>b</ul><template><p>no<button>n</template><p>c") == ["a", "b", "c"]


def test_decoding_never_keeps_a_node_below_a_dropped_one():
    nodes = main_text.in_order(main_text.parse("<div><p>a</p><p>b</p></div><div><p>c</p></div>"))
    assert main_text.decode(nodes, np.array([9, -9, 1, 1, 1, 1, 2, 3, 3, 3.0])[:len(nodes)]) == ["c"]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_posting_lists_recall_and_scores(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, float) for r in df.collect()}
    got = {}
    for r in posting_lists.search(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    recall = []
    for q in (i for i in rows if i % 20 == 0):
        near = sorted((-float(rows[q] @ v), i) for i, v in rows.items() if i != q)[:20]
        own = sorted(got[q])
        assert [r for r, _, _ in own] == list(range(1, 21))
        assert own == sorted(own, key=lambda x: (-x[2], x[1])) and all(abs(s - rows[q] @ rows[i]) < 1e-9 for _, i, s in own)
        recall.append(len({i for _, i in near} & {i for _, i, _ in own}) / 20)
    assert np.mean(recall) >= 0.95


def test_posting_lists_of_odd_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [1.0, 2.0, 3.0], 0) for i in range(0, 900)]  # one vector very often
    rows += [(i, rng.standard_normal(3).tolist(), None) for i in range(900, 1000)]
    rows += [(1000, None, 0), (1020, [0.0, 0.0, 0.0], 0), (1040, [1.0, None, 0.0], 0), (1060, [float("inf"), 0.0, 1.0], 0), (1080, [1.0, 2.0], 0),
             (None, [1.0, 1.0, 1.0], 0), (0, [1.0, 2.0, 3.0], 0)]
    got = posting_lists.search(vectors(spark, rows)).collect()
    assert {r.query_id for r in got} == set(range(0, 1000, 20))
    assert [r.vec_id for r in sorted(got) if r.query_id == 40] == list(range(20))
    assert sorted(r.vec_id for r in posting_lists.search(vectors(spark, rows[900:903] + [(20, [1.0, 0.0, 0.0], 0)])).collect()
                  if r.query_id == 20) == [900, 901, 902]
    assert posting_lists.search(vectors(spark, [])).count() == 0


def test_posting_lists_fill_tight_groups_and_outliers(spark):
    rng = np.random.default_rng(7)
    x = np.eye(16)[0] + 0.1 * rng.standard_normal((640, 16))
    first = np.random.default_rng(1).permutation(640)  # the first five become centroids
    x[first[[0, *range(5, 13)]]] = -np.eye(16)[0] + 1e-9 * rng.standard_normal((9, 16))  # nine nearly equal vectors
    x[first[1]] = -np.eye(16)[1]  # one alone
    x[first[[2, *range(13, 18)]]] = -np.eye(16)[2]  # six equal ones
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v, 0) for i, v in enumerate(x.tolist())]
    got = {}
    for r in posting_lists.search(vectors(spark, rows), every=1).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert len(got) == 640 and all(len(set(ids)) == 20 for ids in got.values())
    few = posting_lists.search(vectors(spark, rows[:14]), every=1)
    assert {r["count"] for r in few.groupBy("query_id").count().collect()} == {13}


def test_posting_lists_search_every_list_within_the_ratio():
    c = np.random.default_rng(2).standard_normal((400, 64))
    index = posting_lists.Index(np.concatenate([c / np.linalg.norm(c, axis=1, keepdims=True), np.zeros((400, 1))], axis=1), 1.0)
    q = index.centroids[:1] * 0.1
    d = np.linalg.norm(index.centroids - q, axis=1)
    lists, first = index.probes(q, np.full(400, 128), 21)
    within = set(np.flatnonzero(d <= posting_lists.PROBE * d.min()).tolist())
    assert set(lists[0].tolist()) == within and len(within) > 300 and first == [1]


def test_far_lists_give_few_rows(spark, monkeypatch):
    """Every round raises the score that rows must reach, so that far lists give few; the result is as by brute force."""
    answers, made = posting_lists._answers, []

    def counted(*args):
        rows = answers(*args)
        made.append(rows.count())
        return rows

    monkeypatch.setattr(posting_lists, "_answers", counted)
    rng = np.random.default_rng(12)
    x = rng.standard_normal((6000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in posting_lists.search(vectors(spark, [(i, v, 0) for i, v in enumerate(x.tolist())]), every=60, k=5).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = {q: [int(i) for i in np.argsort(-(x @ x[q]), kind="stable") if i != q][:5] for q in range(0, 6000, 60)}
    assert sum(len(set(got[q]) & set(w)) for q, w in want.items()) >= 0.95 * 500
    assert len(made) > 1 and sum(made) < 2600


def test_queries_end_when_more_lists_bring_nothing(spark, monkeypatch):
    """Vectors in tight groups are found in the near lists; the rounds behind ask nothing for queries that have settled."""
    answers, asked = posting_lists._answers, []

    def counted(asking, *args):
        asked.append(asking.count())
        return answers(asking, *args)

    monkeypatch.setattr(posting_lists, "_answers", counted)
    monkeypatch.setattr(posting_lists, "LIST", 16)
    monkeypatch.setattr(posting_lists, "ROUNDS", (1, 2))
    monkeypatch.setattr(posting_lists, "PROBE", 100.0)  # every list may be asked
    rng = np.random.default_rng(5)
    x = np.repeat(rng.standard_normal((60, 16)), 50, axis=0) + 0.01 * rng.standard_normal((3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in posting_lists.search(vectors(spark, [(i, v, 0) for i, v in enumerate(x.tolist())]), every=50, k=10).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = {q: [int(i) for i in np.argsort(-(x @ x[q]), kind="stable") if i != q][:10] for q in range(0, 3000, 50)}
    assert sum(len(set(got[q]) & set(w)) for q, w in want.items()) >= 0.95 * 600
    assert sum(asked) < 0.7 * 60 * (3000 // 128) and asked[-1] < asked[-2]


def test_hamming_search_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(64).tolist(), 0) for i in range(300)] + [(i, [1.0] * 64, 0) for i in range(300, 500)]
    df = vectors(spark, rows + [rows[0], (600, None, 0), (700, [None], 0), (None, [1.0] * 64, 0)])
    signs = {i: np.array(v) > 0 for i, v, _ in rows}
    want = set()
    for q in range(0, 500, 100):
        near = sorted((int((signs[q] != s).sum()), i) for i, s in signs.items() if i != q)[:10]
        want |= {(q, n + 1, i, d) for n, (d, i) in enumerate(near)}
    assert {tuple(r) for r in hamming.top_k(df).collect()} == want
    assert hamming.top_k(vectors(spark, [])).count() == 0
    assert [tuple(r) for r in hamming.top_k(vectors(spark, [(0, [1.0], 0), (5, [-1.0], 0)])).collect()] == [(0, 1, 5, 1)]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for f in os.listdir(folder):
        db.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{folder}/{f}'")
    df = queries.QUERIES[name](spark, folder)
    cols = ", ".join(df.columns)
    want = db.execute(f"SELECT {cols} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))


def test_pipeline_stages_keep_columns_and_take_effect(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, counts = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == names
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] < counts[0]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r.doc_id for r in last} == {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == {r.doc_id for r in last}


def test_every_row_of_a_page_id_is_a_record(spark):
    rows = [(1, "u", "a" * 1200), (1, "u", "b" * 5), (2, "u", "a" * 1200), (2, "v", "a" * 1200), (3, None, None), (3, "u", "b" * 5), (None, "u", "x")]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    sizes = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got if r.refers_to is None)
    assert len(got) == 6 and sizes == [(1, 5, "response", None), (2, 1200, "response", None), (2, 1200, "response", None),
                                       (3, 0, "response", None), (3, 5, "response", None)]
    assert [(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got if r.refers_to] == [(1, 1200, "revisit", 2)]


@pytest.mark.parametrize("page", ["<a " * 300_000, "<a '" * 250_000 + '"', "<div>" * 80_000 + "</p>" * 100_000, '<a "' * 250_001, "<td>" * 200_000,
                                  "<" * 1_000_000, "<button>" * 100_000, "<div><li>" * 90_000])
def test_a_megabyte_of_broken_markup(page):
    start = time.process_time()
    main_text.parse(page)
    assert time.process_time() - start < 20  # seconds on a loaded machine; a quadratic scan takes hours


def test_codes_beyond_the_kth_leave_the_join(spark, monkeypatch):
    """Later rounds join under the distance of the kth id found so far; the result is that of brute force."""
    plans, written = [], hamming.written_table

    def watched(df, label):
        plans.append((label, df._jdf.queryExecution().optimizedPlan().toString()))
        return written(df, label)

    monkeypatch.setattr(hamming, "written_table", watched)
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(300, 64)) + rng.normal(size=(30, 64)).repeat(10, axis=0)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(300 + i, vectors[0].tolist()) for i in range(15)]
    got = hamming.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=50, k=10).collect()
    signs = np.array([v for _, v in rows]) > 0
    want = {}
    for q in range(0, len(rows), 50):
        far = (signs != signs[q]).sum(axis=1)
        want[q] = sorted((int(far[i]), i) for i in range(len(rows)) if i != q)[:10]
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.distance, r.vec_id))
    assert found == want
    joins = [line for label, plan in plans if label == "found" for line in plan.split("\n") if "Join" in line and "probe" in line]
    assert len(joins) > 1 and all("bit_count" in line and "bound" in line for line in joins)
