"""Pages, vectors, registration and the pipeline."""

import importlib
import math
import os
import random
import subprocess
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from boxlore import session
from boxlore.llm import main_text, queries, vector_dedup
from boxlore.llm.queries import tokenizer_path
from boxlore.llm.tokens import Encoder
from boxlore.session import Scratch
from tests.llm.test_documents import near_groups, reach, removed


@pytest.fixture
def own(spark):
    with Scratch(spark) as scratch:
        yield scratch


def text_of(page, templates=frozenset()):
    root = main_text.parse(page)
    main_text.spare(root)
    main_text.hash_subtrees(root)
    return "\n\n".join(main_text.blocks(main_text.main_roots(root), templates))


@pytest.mark.parametrize("page,want", [
    ("", ""),
    ("just text", "just text"),
    ("<nav><a>x</a></nav><article><h1>T &amp; U</h1><p>a <b>b\n c</b><br>d<p>e</article><footer>f</footer>", "T & U\n\na b c d\n\ne"),
    ("<main><div class='sidebar'>s</div><ul><li>1<li>2</ul><form>no</form></main>tail", "1\n\n2"),
    ("<article><p>a<!-- <p>no --><script>if (a<b) '</p>'</script>b</p><section class='comments'><p>c</p></section></article>", "ab"),
    ("<article><header><h2>H</h2><p>by</p></header><p>x &lt;y&gt; &#233;&nbsp;z</p><aside>n</aside>", "H\n\nx <y> é z"),
    ("<article><p>cut &am", "cut &am"),
    ("<article><p>cut <a href=\"x", "cut"),
    ("<div><p>a</div></span></div><p title='1>2'>b</p>", "a\n\nb"),
    ("<body><div id='cookie-notice'>ok?</div><p>a</p><p hidden>h</p><div role=navigation>n</div></body>", "a"),
    ("<article><table><tr><td>1<td>2<tr><td>3</table></article><article class='teaser'>t</article>", "1\n\n2\n\n3"),
    ("<form><nav>n</nav><article><p>words of the article</p></article><input></form>", "words of the article"),
    ("<form action=/x><p>words of a page that is one form</p></form><p>b</p>", "words of a page that is one form\n\nb"),
    ("<div class='has-sidebar'><article><p>a</p></article></div><div class='sidebar'>s</div>", "a"),
    ("<div class=no-sidebar><p>a</p><div id=sidebar-left>s</div></div>", "a"),
    ("<div class='comments-enabled'><main><p>a</p><div class='comments-list'>c c c c</div></main></div>", "a"),
    ("<article><p>a</p><section id='related-work'><p>r</p></section><p class='share-price'>s</p><div class='related-posts'>x</div></article>", "a\n\nr\n\ns"),
    ("<article><p title=it's>a</p><p>it's b</p><p title=\"x>y\">c</p><a href=/q?a='1'>d</a></article>", "a\n\nit's b\n\nc\n\nd"),
    ("<div class='comments'><p>comments that are longer than all the rest</p></div><p>a</p>", "a"),
    ("<div class='ad'><p>an advert that is longer than all the rest</p></div><p>a</p>", "a"),
    ("<article><p>an article</p><form><p>join</p></form></article>", "an article"),
    ("<p>" * 3000 + "deep", "deep"),
    ("<div>" * 5000 + "x", "x"),
])
def test_main_text(page, want):
    assert text_of(page) == want


def test_templates_of_a_host(spark, own):
    page = lambda i, host: (i, f"https://{host}/p{i}", f"<body><div><p>Welcome to   the site</p></div><p>own text {i}</p><p>Welcome to the site</p></body>", "x")
    article = "<article><p>quoted line</p></article>"
    rows = [page(i, "A.example.org") for i in range(6)] + [page(i, "b.example.org") for i in range(10, 13)]
    rows += [(20 + i, "https://c.example.org/", article, None) for i in range(8)] + [(30, None, None, None), (31, "no url", "", None), (None, "x", "<p>t</p>", None), (0, *page(0, "A.example.org")[1:])]
    got = main_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, host string"), own)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = got.collect()
    assert len(found) == len(rows) and all(r.n_chars == len(r.text) for r in found)
    text = {r.page_id: r.text for r in found}
    assert all(text[i] == f"own text {i}" for i in range(6))
    assert text[10] == "Welcome to the site\n\nown text 10\n\nWelcome to the site"
    assert text[20] == "quoted line" and text[30] == "" and text[31] == "" and text[None] == "t"
    assert main_text.extract(spark.createDataFrame([], "page_id bigint, url string, html string"), own).count() == 0


def texts_of(spark, own, pages):
    rows = [(i, url, page) for i, (url, page) in enumerate(pages)]
    return [r.text for r in main_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string"), own).orderBy("page_id").collect()]


def test_templates_are_a_share_of_distinct_pages(spark, own):
    site = "<div><p>Site notice for all</p></div>"
    own_text = lambda i: f"own words of the page number {i} and some more of them"
    pages = [("http://big.example/", f"<body>{site}<p>{own_text(i)}</p>{'<h2>Often</h2>' if i < 8 else ''}</body>") for i in range(40)]
    got = texts_of(spark, own, pages)
    assert got[0] == own_text(0) + "\n\nOften" and got[30] == own_text(30)
    # copies are one page, under one key or many; pages without a host, or on a relative url, are no host
    copy = "<body><p>copied words one</p><p>copied words two</p></body>"
    assert texts_of(spark, own, [("http://copy.example/", f"<!-- {i} -->{copy}") for i in range(9)]) == ["copied words one\n\ncopied words two"] * 9
    assert texts_of(spark, own, [(u, f"<body>{site}<p>{i}</p></body>") for i, u in enumerate([None, "/a", "b", "", None, "/c"])])[0] == "Site notice for all\n\n0"
    # what holds most of a page stays whole
    most = "<div><p>a long text that every page holds</p><p>and another part of that text</p></div>"
    assert texts_of(spark, own, [("http://most.example/", f"<body>{most}<p>{i}</p></body>") for i in range(6)])[0].startswith("a long text that every page holds\n\nand another")


@pytest.mark.parametrize("tag", ["article", "main"])
def test_templates_inside_the_main_part(spark, own, tag):
    box = "<div><p>Join our list</p></div>"
    quote = "<p>To be or not</p>"
    own_text = lambda i: f"own words of the page number {i} and some more of them"
    pages = [("http://in.example/", f"<body><{tag}><p>{own_text(i)}</p>{quote if i < 8 else ''}{box}</{tag}></body>") for i in range(20)]
    pages += [("http://in.example/copy", pages[0][1])] * 30
    got = texts_of(spark, own, pages)
    assert got[:8] == [own_text(i) + "\n\nTo be or not" for i in range(8)] and got[8:20] == [own_text(i) for i in range(8, 20)]
    assert got[20:] == got[:1] * 30


@pytest.mark.parametrize("chunk,pivots", [(2048, 24), (7, 3)])
def test_vector_links(spark, own, chunk, pivots):
    rng = np.random.default_rng(4)
    rows, i = [], 0
    for label in (0, 1, None):
        for _ in range(12):
            base = rng.standard_normal(16)
            for k in range(rng.integers(1, 7)):
                v = base * rng.uniform(0.1, 9) if k == 1 else base + rng.standard_normal(16) * 0.09 * rng.uniform(0, 2) * np.abs(base).mean()
                rows.append((i, v.astype(np.float32).tolist(), label, "x"))
                i += 1
    rows += [(i + k, v, 0, "x") for k, v in enumerate([None, [], [0.0] * 16, [None] * 16, [math.nan] * 16, [math.inf] * 16, [1.0, 2.0], [2.0, 4.0], [1e-30] * 16, [1e30] * 16])]
    rows += [(i + 20 + k, rows[0][1], 0, "x") for k in range(9)] + [(None, rows[0][1], 0, "x")]
    rows.append(rows[3])
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, component string").repartition(3)
    got = vector_dedup.links(frame, own, chunk=chunk, pivots=pivots).collect()
    keyed = [r for r in rows if r[0] is not None]
    unit = []
    for _, v, label, _ in keyed:
        x = np.array([np.nan if c is None else c for c in v or [0]], float)
        ok = label is not None and np.isfinite(x).all() and np.abs(x).max() > 0
        unit.append(x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max()) if ok else None)
    near = [(a, b) for a in range(len(keyed)) for b in range(len(keyed)) if a != b and unit[a] is not None and unit[b] is not None and keyed[a][2] == keyed[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98]
    component = reach([r[0] for r in keyed], [(keyed[a][0], keyed[b][0]) for a, b in near])
    want = sorted((r[0], sum(1 for a, _ in near if a == k), component[r[0]]) for k, r in enumerate(keyed))
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert vector_dedup.links(frame.limit(0), own).count() == 0


def test_pairs_of_a_large_cell_are_dealt_out(spark, own, monkeypatch):
    """Pairs of chunks of one label and cell lie in many tasks once they are more than a task's share."""
    monkeypatch.setattr(vector_dedup, "TASK", 1 << 12)
    r = np.random.default_rng(5)
    rows = [(i, 1, [float(x) for x in v]) for i, v in enumerate(r.standard_normal((120, 4)))]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    seen, real = [], vector_dedup._dealt
    monkeypatch.setattr(vector_dedup, "_dealt", lambda *args: seen.append(real(*args)) or seen[-1])
    got = {x.vec_id: x.n_links for x in vector_dedup.links(df, own, threshold=0.9, pivots=1, chunk=20).collect()}
    v = np.array([x[2] for x in rows])
    v /= np.sqrt((v * v).sum(1, keepdims=True))
    assert got == dict(enumerate(((v @ v.T >= 0.9).sum(1) - 1).tolist()))
    assert max(x["count"] for x in seen[0].groupBy(F.spark_partition_id()).count().collect()) * 4 < seen[0].count()


def test_vectors_are_stored_once_whatever_they_reach(spark, own, monkeypatch, capsys):
    """Chunks hold each vector once, and pairs of chunks are made where they are read."""
    r = np.random.default_rng(8)
    v = np.concatenate([r.standard_normal((90, 24)), r.standard_normal(24) + 0.02 * r.standard_normal((70, 24)), r.standard_normal((8, 24)).repeat(5, 0) * r.uniform(0.5, 2, (40, 1))])
    label = np.where(np.arange(len(v)) < 190, 3, 4)
    df = spark.createDataFrame([(i, int(label[i]), x.tolist()) for i, x in enumerate(v)], "vec_id long, label int, embedding array<double>")
    seen, real = [], vector_dedup._dealt
    monkeypatch.setattr(vector_dedup, "_dealt", lambda *args: seen.append((args[0], real(*args))) or seen[-1][1])
    monkeypatch.setattr(vector_dedup, "BLOCK", 9)
    monkeypatch.setattr(vector_dedup, "HELD", 40)
    got = {x.vec_id: (x.n_links, x.component_id) for x in vector_dedup.links(df, own, chunk=16).collect()}
    unit = v / np.sqrt((v * v).sum(1, keepdims=True))
    a, b = np.nonzero((unit @ unit.T >= 0.98) & (label[:, None] == label) & ~np.eye(len(v), dtype=bool))
    component = reach(range(len(v)), list(zip(a.tolist(), b.tolist(), strict=True)))
    n = np.bincount(a, minlength=len(v)).tolist()
    assert got == {i: (n[i], component[i]) for i in range(len(v))} and max(n) >= 60
    (chunks, pairs), = seen
    stored = [i for r in chunks.collect() for i in np.frombuffer(r.id, np.int64).tolist()]
    assert sorted(stored) == list(range(len(v))) and any(len(r.cells) > 1 for r in chunks.collect())
    capsys.readouterr()
    pairs.explain()
    plan = capsys.readouterr().out
    assert "CartesianProduct" in plan and "Exchange" not in plan


def test_queries_are_registered():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert {int(n[2:].split("_")[0]) for n in names if n in queries.QUERIES and n.startswith("op")} == set(range(1, 14)) and "pipeline" in names
    assert set(queries.SQL) <= set(names) and entry.oracle_sql().keys() >= queries.SQL.keys()


def test_entry_works_without_the_subpackage(tmp_path):
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for name in os.listdir(here):
        if name in ("boxlore", "suite", "__spark_entry__.py"):
            os.symlink(os.path.join(here, name), tmp_path / name) if name != "boxlore" else os.mkdir(tmp_path / name)
    for name in os.listdir(os.path.join(here, "boxlore")):
        if name != "llm":
            os.symlink(os.path.join(here, "boxlore", name), tmp_path / "boxlore" / name)
    code = "import __spark_entry__ as e, sys; assert 'boxlore.llm' not in sys.modules; q = e.queries(); print(len(q), any(n.startswith('op1_') for n in q), 'pipeline' in q)"
    # The symlinked entry file would put its real folder on the path first: read it as text instead.
    (tmp_path / "entry.py").write_text(open(os.path.join(here, "__spark_entry__.py")).read())
    out = subprocess.run([sys.executable, "-c", code.replace("__spark_entry__", "entry")], cwd=tmp_path, capture_output=True, text=True, timeout=120, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert out.returncode == 0, out.stderr
    assert out.stdout.split()[1:] == ["False", "False"] and int(out.stdout.split()[0]) > 100


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdeinorst") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    docs = [(i, text(rng.randint(30, 150))) for i in range(240)]
    item, shared = text(30), text(40)
    for i in range(0, 240, 4):
        docs[i] = (i, docs[i][1] + " grobzug grobnak grobber " + text(5))
    docs[1], docs[3], docs[5], docs[7] = (1, docs[9][1]), (3, docs[11][1] + " tail"), (5, text(20) + " " + item + " " + text(20)), (7, text(30) + " " + shared)
    docs[10] = (10, shared + " " + text(30))
    docs += [(300, None), (301, ""), (None, text(40))]
    n = lambda t: None if t is None else len(t)
    frame = spark.createDataFrame([(i, t, "en", "s", n(t)) for i, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(240)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) if name != "packing" else None
        out = stage(spark, kept, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "packing":
            break
        assert kept.columns == frame.columns
        after = {r.doc_id: r.text for r in kept.collect()}
        seen.append(len(after))
        if name == "toxicity":
            assert sum(i % 4 == 0 for i in after if i is not None and i < 240) <= 3 and len(after) >= 175
        elif name == "near_dedup":
            _, component = near_groups([r for r in before if r[0] is not None], 80)
            assert set(after) - {None} == {i for i, c in component.items() if i == c}
            assert (9 in after, 11 in after) == (1 not in after, 3 not in after)
        elif name == "span_dedup":
            want = removed([r for r in before if r[0] is not None])
            assert {i: (t or "") for i, t in after.items() if i is not None} == {i: w[3].decode("utf-8", "ignore") for i, w in want.items()}
            assert all(r.n_chars == n(r.text) for r in kept.collect())
        else:
            assert {i for i, _ in before} - set(after) == {5}
        assert None in after and 300 in after and 301 in after
    pieces = kept.collect()
    assert {r.doc_id for r in pieces} == set(after)
    assert corpus_pipeline.ORACLE_SQL is None
    session.release(spark)
    tables = lambda: {t.tableName for t in spark.sql(f"SHOW TABLES IN {session.SCRATCH}").collect() if not t.isTemporary}
    open_ = tables()
    whole = corpus_pipeline.run(spark, str(tmp_path))
    what = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert len(tables() - open_) == 1
    texts_of_all = Encoder(tokenizer_path()).encode(list(after.values()), 1)
    ids = dict(zip(after, texts_of_all, strict=True))
    found = sorted((tuple(r) for r in whole.select(what).collect()), key=str)
    for i, start, length, crc, total in found:
        assert total == len(ids[i]) and crc == zlib.crc32(ids[i][start : start + length].tobytes())
    assert sum(r[2] for r in found) == sum(map(len, ids.values())) and {r[0] for r in found} == set(after)
    session.release(spark)
    assert tables() == open_
