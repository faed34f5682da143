"""Language ID, quality grades, page text, archives, and the pipeline."""

import html as entities
import re

import numpy as np
import pytest

import corpus_pipeline
from compare import difference, duck
from eventlane.llm import archive, html_text, langid, quality, queries, warc
from eventlane.llm.common import table
from eventlane.llm.html_pages import labelled_pages
from eventlane.llm.oracle import ORACLE

SF_DIR = "/root/testdata/sf0.001"
SMALL = "/root/testdata/sf0.01"


# --- language ID --------------------------------------------------------------------------


def test_held_out_languages(spark):
    found = queries.op10_language(spark, SMALL).join(table(spark, SMALL, "documents").select("doc_id", "lang", "text"), "doc_id").toPandas()
    held = found[found["held_out"] & found["lang"].notna()]
    assert len(held) > 200 and (held["lang_pred"] == held["lang"]).mean() >= 0.98
    assert found["score"].between(0, 1).all()
    crc = [__import__("zlib").crc32(str(i).encode()) % 3 == 1 for i in found["doc_id"]]
    assert (found["held_out"] == crc).all()


@pytest.mark.parametrize("languages", [2, 4, 7, 12, 40])
def test_codewords_are_apart(languages):
    code = langid.codewords(languages).astype(int)
    apart = (code.shape[1] - code @ code.T) // 2
    assert apart[~np.eye(languages, dtype=bool)].min() >= min(code.shape[1], max(1, code.shape[1] // 5))
    assert (abs(code.sum(axis=0)) < languages).all()


def test_language_edges(spark):
    schema = "doc_id long, text string, lang string, score int"
    rows = [(1, "the cat and the dog were here", "en", 1), (2, "der hund und die katze waren da", "de", 1)] * 4 + [(9, None, "en", 1), (10, "12 34 !!", "de", 1), (11, "", None, 1), (12, "the dog " * 200_000, None, 1)]
    df = spark.createDataFrame(rows, schema)
    model = langid.train(df)
    found = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert found[1].lang_pred == "en" and found[2].lang_pred == "de" and found[12].lang_pred == "en"
    assert all(found[i].lang_pred == "und" and found[i].score == 0 and not found[i].ambiguous for i in (9, 10, 11))
    assert langid.understood(df, model).columns == df.columns and sorted({r.doc_id for r in langid.understood(df, model).collect()}) == [1, 2, 12]
    assert langid.identify(df.limit(0), model).collect() == []
    assert {r.lang_pred for r in langid.identify(df, langid.train(df.limit(0))).collect()} == {"und"}
    one = langid.identify(df, langid.train(df.where("lang = 'en'")))
    assert {r.lang_pred for r in one.where("text is not null and doc_id < 9").collect()} == {"en"}


# --- quality ------------------------------------------------------------------------------


def test_held_out_grades(spark):
    docs, rated = table(spark, "/root/testdata/sf0.1", "documents"), queries.ratings(spark, "/root/testdata/sf0.1")
    model = quality.train(docs, rated.where("doc_id % 3 <> 0"))
    found = quality.grade(docs.join(rated, "doc_id").where("doc_id % 3 = 0"), model).select("grade", "selected", "expected_grade").toPandas()
    good = found["grade"] == 2
    assert (found["selected"] == good).mean() >= 0.98
    assert found["selected"][good].mean() >= 0.99
    assert (np.diff(model.thresholds) >= 0).all() and found["expected_grade"].between(0, 2).all()


def test_training_ignores_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "good words here" if i % 2 else "bad stuff there", 7, 8, 9) for i in range(40)], "doc_id long, text string, grade int, rated_id int, known_id int")
    ratings = spark.createDataFrame([(i, i % 2, "x") for i in range(40)], "doc_id long, grade int, text string")
    model = quality.train(docs, ratings)
    assert model.grades.tolist() == [0, 1] and {r.doc_id % 2 for r in quality.select(docs, model).collect()} == {1}


def test_quality_edges(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(["fine words here", "bad stuff here", None, "", "fine " * 100_000])] * 8, "doc_id long, text string, tail string")
    rated = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (3, None), (None, 1)], "doc_id long, grade int")
    model = quality.train(docs, rated)
    found = {r.doc_id: r for r in quality.grade(docs, model).collect()}
    assert found[0].selected and not found[1].selected and found[4].tail > found[1].tail
    assert quality.select(docs, model).columns == docs.columns
    assert quality.grade(docs.limit(0), model).collect() == []
    unrated = quality.train(docs, rated.limit(0))
    assert all(r.tail is None for r in quality.grade(docs, unrated).collect())
    assert quality.select(docs, unrated).count() == docs.count()
    assert all(r.expected_grade == 1 and r.tail == 1 for r in quality.grade(docs, quality.train(docs, rated.where("grade = 1"))).collect())


# --- page text ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def extractor():
    return html_text.train()


def test_labelled_pages_held_out(extractor):
    pages = labelled_pages(200, seed=77)
    wrong = sum(a != b for page, labels in pages for a, b in zip(extractor.viterbi(html_text.blocks(page)), labels, strict=True))
    assert wrong <= 0.01 * sum(len(labels) for _, labels in pages)


def test_viterbi_is_the_best_of_all_labellings(extractor):
    page = labelled_pages(1, seed=5)[0][0]
    own = html_text.blocks(page)[:9]
    scores, steps = extractor.states(own), extractor.steps
    value = lambda y: sum(s for s, v in zip(scores, y, strict=True) if v) + sum(steps[a][b] for a, b in zip(y, y[1:], strict=False))
    best = max((tuple(n >> k & 1 for k in range(len(own))) for n in range(1 << len(own))), key=value)
    assert [bool(v) for v in best] == extractor.viterbi(own)


def test_html_query_against_the_article_tag(spark):
    rows = queries.op2_html_text(spark, SMALL).collect()
    pages = {r.page_id: r for r in table(spark, SMALL, "pages").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)(?:</article>|$)", pages[r.page_id].html, re.S)[1]
        parts = [" ".join(entities.unescape(re.sub(r"<[^>]+>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(p for p in parts if p)
        assert r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_blocks_of_broken_markup():
    texts = lambda page: [b.text for b in html_text.blocks(page)]
    assert texts("<p>one<p>two <b>bold<br>line</p><div>a&amp;&lt;b&#233;&nbsp;c") == ["one", "two bold line", "a&<bé c"]
    assert texts("<script>var a='<p>x</p>'</script><p>y</p><!-- <p>z --><style>q</style>") == ["y"]
    assert texts("plain < text & more") == ["plain < text & more"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul></ul><td>d<td>e") == ["a", "b", "c", "d", "e"]
    assert texts("<p>x</p><script>never ends <p>y") == ["x"]
    assert texts('<a title="broken><p>kept</p>') == ["kept"]
    assert texts("") == [] and texts("</div></p><") == ["<"]
    assert texts("<div>" * 3000 + "deep") == ["deep"]


@pytest.mark.parametrize("odd", ["<svg class=x/>", "<canvas>", "<audio src=a>", "<svg>", "<button>", "<math/>", "<video>"])
def test_odd_elements_do_not_swallow_the_page(odd):
    found = [b.text for b in html_text.blocks(f"<article><p>first text</p>{odd}<p>second text</p></article><p>third text</p>")]
    assert found == ["first text", "second text", "third text"]


def test_formulas_are_text():
    page = "<p>area <math><mi>x</mi><msup><mi>y</mi><mn>2</mn></msup></math> end</p><svg><text>drawn</text></svg><p>next</p>"
    assert [b.text for b in html_text.blocks(page)] == ["area xy2 end", "next"]


def test_unclosed_elements_are_looked_up_once():
    import time

    start = time.perf_counter()
    assert len(html_text.blocks("<button><p>some text</p>" * 20_000)) == 20_000
    assert time.perf_counter() - start < 10


def test_html_edges(spark, extractor):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "<article><p>Some words that are an article, of one line.</p></article>", 5)] * 2, "page_id long, html string, text int")
    found = sorted((r.page_id, r.text) for r in html_text.extract(df, extractor).collect())
    assert found == sorted([(1, ""), (2, ""), (3, "Some words that are an article, of one line.")] * 2)
    assert html_text.extract(df.limit(0), extractor).collect() == []


# --- archives -----------------------------------------------------------------------------


def test_warc_query(spark):
    assert difference(queries.op6_warc(spark, SMALL), duck(SMALL), ORACLE["op6_warc"]) is None


@pytest.fixture()
def pages(spark):
    big = "é" * 600
    rows = [(1, "http://a/\r\nX: y", big, 0), (2, None, big, 0), (3, "http://b", "small", 0), (4, "http://c", "small", 0), (5, "http://d", None, 0), (6, "http://e", "", 0), (7, "http://f", "z" * 300_000, 0), (None, "http://g", big, 0), (2, None, big, 0)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload int")


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_archive_round_trip(spark, pages, compression):
    path = archive.archived(archive.page_records(pages.repartition(3)), compression=compression, maxFileBytes="500")
    assert all(name.endswith(".gz") == (compression == "gzip") for name, _ in warc.listed(path)) and len(warc.listed(path)) > 1
    back = spark.read.format("warc").option("splitBytes", "2000").load(path)
    rows = sorted(((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in archive.page_rows(back).collect()), key=str)
    assert rows == sorted([(0, 1200, "revisit", 2), (1, 1200, "revisit", 2), (2, 1200, "response", None), (2, 1200, "response", None), (3, 5, "response", None), (4, 5, "response", None), (5, 0, "response", None), (6, 0, "response", None), (7, 300_000, "response", None)], key=str)
    payloads = {r.record_id: bytes(r.payload).decode() for r in back.where("record_type = 'response'").collect()}
    assert payloads["urn:page:2"] == "é" * 600 and payloads["urn:page:5"] == ""
    assert {r.target_uri for r in back.where("record_id = 'urn:page:1'").collect()} == {"http://a/%0D%0AX: y"}
    again = archive.archived(archive.page_records(pages.limit(0)))
    assert spark.read.format("warc").load(again).collect() == []


def test_filters_reach_the_reader_and_payloads_are_skipped(spark, pages, monkeypatch):
    path = archive.archived(archive.page_records(pages), compression="none")
    back = spark.read.format("warc").load(path).where("record_type = 'revisit' and target_uri is not null")
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "+- *(1) Filter" not in plan and "Filter (" not in plan
    assert back.count() == 2
    narrow = spark.read.format("warc").schema("record_id string, record_type string").load(path)
    assert narrow.where("record_id in ('urn:page:3', 'urn:page:7')").count() == 2
    reader = warc.WarcReader(path, narrow.schema, 1 << 20)
    taken = []
    plain = warc._Plain.readinto
    monkeypatch.setattr(warc, "_CHUNK", 4096)
    monkeypatch.setattr(warc._Plain, "readinto", lambda self, b: taken.append(plain(self, b)) or taken[-1])
    assert sum(batch.num_rows for p in reader.partitions() for batch in reader.read(p)) == 9
    assert sum(taken) < 100_000  # the archive holds a payload of 300,000 bytes


def test_files_of_a_lost_task_are_never_listed(tmp_path):
    """An attempt that wrote and never committed leaves a file; the list holds what was committed."""
    import pyarrow as pa

    schema = "record_id string, record_type string, payload binary"
    row = pa.RecordBatch.from_pylist([{"record_id": "urn:x", "record_type": "response", "payload": b"abc"}])
    path = str(tmp_path / "archives")
    first = warc.WarcWriter(path, True, 1 << 20, schema)
    first.write(iter([row]))
    first.commit([first.write(iter([row])), None])
    assert len(warc.listed(path)) == 1
    # A job that fails before any commit leaves nothing for the next one either.
    second = warc.WarcWriter(str(tmp_path / "other"), True, 1 << 20, schema)
    second.write(iter([row]))
    third = warc.WarcWriter(str(tmp_path / "other"), True, 1 << 20, schema)
    third.commit([third.write(iter([row]))])
    assert len(warc.listed(str(tmp_path / "other"))) == 1


def test_copies_become_revisits(spark):
    """Groups of copies, short ones, empty ones and a hot one, against plain counting."""
    big, hot = "<p>" + "body " * 300 + "</p>", "<p>" + "hot " * 400 + "</p>"
    rows = [(i, f"u{i}", hot if i % 3 == 0 else big + str(i // 4) if i % 3 == 1 else ["", None, "short"][i % 9 // 3]) for i in range(120)]
    own = spark.createDataFrame(rows, "page_id long, url string, html string")
    back = archive.page_rows(spark.read.format("warc").load(archive.archived(archive.page_records(own.repartition(5)))))
    largest = {}
    for i, _, html in rows:
        if html and len(html.encode()) >= 1000:
            largest[html] = max(i, largest.get(html, i))
    want = [(i, len((h or "").encode()), "revisit" if largest.get(h, i) != i else "response", largest[h] if largest.get(h, i) != i else None) for i, _, h in rows]
    got = sorted(tuple(r) for r in back.select("page_id", "payload_bytes", "record_type", "refers_to").collect())
    assert got == want and sum(r[2] == "revisit" for r in want) > 40


def test_gzip_members_are_records(spark, pages):
    import gzip

    path = archive.archived(archive.page_records(pages.coalesce(1)))
    name = warc.listed(path)[0][0]
    with open(f"{path.removeprefix('file://')}/{name}", "rb") as file:
        data = gzip.decompress(file.read())
    assert data.count(b"WARC/1.1\r\n") == 9 and b"WARC-Profile" in data and b"WARC-Payload-Digest: sha1:" in data


# --- the pipeline -------------------------------------------------------------------------


def test_stages_are_the_contract():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "quality classifier", "SimHash near-dedup", "benchmark decontamination", "BPE encoding and decoding"]


def test_pipeline_against_its_operators(spark):
    """Each stage's decision, from what brute force or the operator's own query says of its input."""
    from test_near_duplicates import brute_simhash

    docs = table(spark, SMALL, "documents")
    columns = docs.columns
    rows, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = spark.createDataFrame(stage(spark, rows, SMALL).toPandas(), docs.schema)
        assert rows.columns == columns
        kept[name] = {r.doc_id: r.text for r in rows.collect()}
    every = {r.doc_id for r in docs.collect()}
    named = {r.doc_id for r in queries.op10_language(spark, SMALL).where("lang_pred <> 'und' and not ambiguous").collect()}
    assert set(kept["language ID"]) == named
    rated = {r.doc_id: r.grade for r in queries.ratings(spark, SMALL).collect()}
    good = set(kept["quality classifier"])
    assert sum((i in good) == (rated[i] == 2) for i in named & set(rated)) >= 0.98 * len(named & set(rated))
    _, root = brute_simhash(list(kept["quality classifier"].items()), 2)
    assert set(kept["SimHash near-dedup"]) == {i for i, r in root.items() if i == r}
    leaks = {r.doc_id for r in queries.op8_decontamination(spark, SMALL).collect()}
    assert set(kept["benchmark decontamination"]) == set(kept["SimHash near-dedup"]) - leaks
    last = corpus_pipeline.STAGES[-1][1](spark, rows, SMALL).collect()
    codes = {r.doc_id: r for r in queries.op3_bpe_codec(spark, SMALL).collect()}
    assert len(last) == len(kept["benchmark decontamination"]) < len(every)
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == (c.n_tokens, c.ids_sha256, c.decoded_sha256) for r in last for c in [codes[r.doc_id]])


def test_stages_take_nulls_and_empty_tables(spark):
    docs = table(spark, SF_DIR, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**9, "", "en", None, None), (10**9 + 1, "word " * 30_000, None, "x", 1)], docs.schema)
    rows = docs.union(odd).union(docs.limit(3))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF_DIR).collect() == []
        out = stage(spark, rows, SF_DIR)
        assert out.count() > 0
        rows = out
