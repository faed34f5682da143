"""SimHash, decontamination and embeddings against brute force."""

import re
from itertools import combinations

import duckdb
import numpy as np
import pytest
import xxhash

from compare import difference, duck
from eventlane.llm import decontaminate, embeddings, queries, simhash
from eventlane.llm.common import table
from eventlane.llm.graph import components
from eventlane.llm.oracle import ORACLE

SF_DIR = "/root/testdata/sf0.001"


def roots(nodes, links):
    """Least reachable node of each node, by union-find."""
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in parent}


# --- components ---------------------------------------------------------------------------


def test_components_of_chains_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (5, 5), (-3, 200)]
    df = spark.createDataFrame([*links, (None, 4), (7, None)], "a long, b long")
    expected = roots({n for link in links if link[0] != link[1] for n in link}, links)
    assert {r.node: r.root for r in components(df).collect()} == expected


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# --- SimHash ------------------------------------------------------------------------------


def plain_fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = re.findall("[^\x20\x09-\x0d]+", lower)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(monkeypatch):
    monkeypatch.setattr(simhash, "_AT_ONCE", 7)
    for text in ("", " \t\n", "One", "ONE two", "É É É", "a b c", "a b c\x0bd e " * 9, "word " * 40, "Ärger ÄRGER x y z"):
        assert simhash.fingerprint_of(text, 3) == plain_fingerprint(text)


def brute_simhash(rows, distance):
    prints = {i: plain_fingerprint(t or "") for i, t in rows}
    ids = sorted(prints)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (prints[a] ^ prints[b]).bit_count() <= distance]
    return prints, roots(ids, links)


def test_simhash_query(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF_DIR, "documents").collect()]
    prints, root = brute_simhash(rows, 2)
    found = queries.op4_simhash(spark, SF_DIR).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in found} == {i: (f"{p:016x}", root[i]) for i, p in prints.items()}


@pytest.mark.parametrize("distance", [0, 1, 2, 3, 4])
def test_ball_links_connect_what_is_near(spark, distance):
    draw = np.random.default_rng(distance)
    base = [int(x) for x in draw.integers(0, 1 << 63, 12)]
    prints = {b ^ sum(1 << int(k) for k in draw.choice(64, n, replace=False)) for b in base for n in (0, 1, 2, 3, 4, 5) for _ in range(4)} | {0, 1, 1 << 63, (1 << 64) - 1}
    if distance > 2:
        prints = set(sorted(prints)[:40])
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    links = [(r.a, r.b) for r in simhash.ball_links(df, distance).collect()]
    bits = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    assert all(bits(a, b) <= distance for a, b in links)
    near = [(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if bits(a, b) <= distance]
    assert roots(signed, links) == roots(signed, near)


def test_simhash_nulls_repeats_and_extra_columns(spark):
    rows = [(5, None, 1, 1), (6, "", 1, 1), (9, "one two three four", 1, 1), (8, "ONE two three four", 1, 1), (8, "ONE two three four", 1, 1), (None, "one two three four", 1, 1), (3, "else " * 5000, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int, id int")
    found = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert found == [(-1, 8), (3, 3), (5, 5), (6, 5), (8, 8), (8, 8), (9, 8)]
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 5, 8]
    assert simhash.near_duplicates(df.limit(0)).collect() == [] and simhash.one_of_each(df.limit(0)).collect() == []


# --- decontamination ----------------------------------------------------------------------


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_decontamination_query(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    assert difference(queries.op8_decontamination(spark, sf_dir), duck(sf_dir), ORACLE["op8_decontamination"]) is None


def test_planted_passages(spark):
    item = [f"word{i}" for i in range(30)]
    changed = [w if i % 7 else "other" for i, w in enumerate(item)]
    far = [w if i % 2 else "other" for i, w in enumerate(item)]
    short = [f"s{i}" for i in range(9)]
    noise = " ".join(f"n{i}" for i in range(500))
    docs = [
        (1, f"{noise} {' '.join(item).upper()}! {noise}", 0, "x"), (2, f"{noise} {', '.join(changed)} {noise}", 0, "x"), (3, f"{noise} {' '.join(far)}", 0, "x"),
        (4, " ".join(item[5:18]), 0, "x"), (5, " ".join(item[5:15]), 0, "x"), (6, None, 0, "x"), (7, "", 0, "x"), (8, noise + " " + " ".join(short), 0, "x"),
        (9, noise * 40, 0, "x"), (10, "tiny item", 0, "x"), (11, " ".join(item), 0, "x"), (11, " ".join(item), 0, "x"), (None, " ".join(item), 0, "x"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string, pos int, item_id string")
    bench = spark.createDataFrame([(70, " ".join(item)), (70, " ".join(item)), (71, " ".join(item)), (72, " ".join(short)), (73, "tiny item"), (74, None), (75, "")], "item_id long, text string")
    rows = [(r.doc_id, r.item_id, r.n_windows, r.similarity) for r in decontaminate.overlaps(df, bench).collect()]
    assert {(d, i) for d, i, _, _ in rows} == {(d, i) for d in (1, 2, 4, 11, None) for i in (70, 71)} | {(8, 72)}
    found = {(d, i): (n, s) for d, i, n, s in rows}
    assert found[1, 70] == found[1, 71] == (18, 1.0) and found[4, 70] == (3, 1.0) and found[2, 71][1] < 1
    kept = decontaminate.without_overlap(df, bench)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 5, 6, 7, 9, 10]
    assert decontaminate.overlaps(df, bench.limit(0)).collect() == [] and decontaminate.overlaps(df.limit(0), bench).collect() == []


def edited_passages():
    """Items of 8 to 15 words, and documents with every choice of as many changed words as 0.8 of a window allows."""
    items, docs = [], []
    for n in (8, 9, 10, 11, 12, 13, 14, 15):
        item = [f"i{n}w{k}" for k in range(n)]
        items.append((n, " ".join(item)))
        for out in combinations(range(n), n - -(-4 * min(n, 13) // 5) - max(0, n - 13)):
            for ahead, behind in (("a b ", " c d"), ("", "")):
                docs.append((len(docs), ahead + " ".join(f"x{k}" if k in out else w for k, w in enumerate(item)) + behind))
    return items, docs


def compared_windows(items, docs):
    """The overlaps by comparing every window with every place."""
    found = {}
    for i, text in items:
        t = text.split()
        width = min(13, len(t))
        for d, body in docs:
            v = body.split()
            for pos in range(len(v)):
                same = max(sum(a == b for a, b in zip(t[p : p + width], v[pos : pos + width])) for p in range(len(t) - width + 1))
                if same >= 0.8 * width:
                    n, best, first = found.get((d, i), (0, 0, pos))
                    found[d, i] = (n + 1, max(best, same / width), first)
    return {(*k, *v) for k, v in found.items()}


def test_decontamination_finds_every_edit(spark):
    items, docs = edited_passages()
    expected = compared_windows(items, docs)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), bench)
    assert {tuple(r) for r in found.select("doc_id", "item_id", "n_windows", "similarity", "first_word").collect()} == expected
    con = duckdb.connect()
    for name, id_col, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", items)):
        con.execute(f"CREATE TABLE {name} ({id_col} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    assert set(con.sql(ORACLE["op8_decontamination"]).fetchall()) == expected


def test_items_that_share_a_window_and_short_items(spark):
    stem = " ".join(f"s{k}" for k in range(13))
    items = [(10, stem), (11, stem), (12, stem + " and more words"), (13, "one two three four five six seven"), (14, "just five words in all"), (15, "only four words here")]
    docs = [(1, f"x {stem} y"), (2, "a one two three four five six seven b"), (3, "one two three four five six other"), (4, "says just five words in all"), (5, "only four words here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(df, bench).collect()}
    assert found == {(1, 10), (1, 11), (1, 12), (2, 13), (4, 14)}
    assert (5, 15) in {(r.doc_id, r.item_id) for r in decontaminate.overlaps(df, bench, shortest=1).collect()}
    con = duckdb.connect()
    for name, id_col, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", items)):
        con.execute(f"CREATE TABLE {name} ({id_col} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    assert {r[:2] for r in con.sql(ORACLE["op8_decontamination"]).fetchall()} == found


def test_stages_judge_rows_with_null_or_equal_ids_by_their_texts(spark):
    stem = " ".join(f"s{k}" for k in range(20))
    rows = [(None, "clean one", 1), (None, f"x {stem}", 2), (None, None, 3), (5, "clean two words", 4), (5, f"{stem} y", 5), (6, "", 6), (5, "clean two words", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row_key int")
    bench = spark.createDataFrame([(1, stem)], "item_id long, text string")
    kept = sorted(r.row_key for r in decontaminate.without_overlap(df, bench).collect())
    assert kept == [1, 3, 6]  # one row of id 5 leaks, so all of that id go
    one = simhash.one_of_each(df)
    assert one.columns == df.columns
    # The null and the empty text are copies; the row with an id stays. The repeated row stays once.
    assert sorted(r.row_key for r in one.collect()) == [1, 2, 4, 5, 6]
    assert simhash.one_of_each(df.limit(0)).collect() == []


@pytest.mark.parametrize("similarity", [1.0, 0.9, 0.8, 0.7, 0.5])
def test_masks_leave_one_untouched(similarity):
    for width in range(8, 14):
        changes = max(c for c in range(width + 1) if width - c >= similarity * width)
        own = decontaminate.masks_of(width, similarity)
        assert all(any(all(m[i] == "0" for i in out) for m in own) for out in combinations(range(width), changes))


def test_decontamination_without_broadcast(spark, monkeypatch):
    before = {(r.doc_id, r.item_id, r.n_windows) for r in queries.op8_decontamination(spark, SF_DIR).collect()}
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST", 0)
    assert {(r.doc_id, r.item_id, r.n_windows) for r in queries.op8_decontamination(spark, SF_DIR).collect()} == before


def test_decontamination_runs_no_python(spark):
    plan = queries.op8_decontamination(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- embeddings ---------------------------------------------------------------------------


def brute_embeddings(rows, threshold=0.93):
    ok = [(i, v, lab) for i, v, lab in rows if v is not None and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, count = [], {}
    unit = [np.array(v, float) / np.linalg.norm(v) for _, v, _ in ok]
    for a in range(len(ok)):
        for b in range(len(ok)):
            if a != b and ok[a][2] == ok[b][2] and len(ok[a][1]) == len(ok[b][1]) and unit[a] @ unit[b] >= threshold:
                links.append((ok[a][0], ok[b][0]))
                count[ok[a][0]] = count.get(ok[a][0], 0) + 1
    return count, roots([r[0] for r in rows], links)


def clustered(n_clusters, each, noise, seed, dims=16):
    draw = np.random.default_rng(seed)
    rows = []
    for c in range(n_clusters):
        centre = draw.normal(size=dims)
        for _ in range(each):
            rows.append((len(rows), [float(x) for x in np.float32(centre + noise * draw.normal(size=dims))], c % 3))
    return rows


@pytest.mark.parametrize("block", [4096, 7])
def test_embeddings_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rows = clustered(60, 6, 0.22, 1) + [(1000 + i, [1.0] * 16, 1) for i in range(25)] + [(1100 + i, [1.0 + 0.001 * i] * 15 + [2.0], 1) for i in range(25)]
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [1.0] * 15 + [float("nan")], 1), (2003, [1.0] * 15 + [None], 1), (2004, [1.0] * 16, None), (2005, [1.0] * 8, 1), (2006, [2.0] * 16, 1), (2007, [float("inf")] * 16, 1), (2008, [1e-30] * 16, 1)]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "vec_id long, embedding array<float>, label int, rep int, mark string")
    count, root = brute_embeddings([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows])
    found = embeddings.near_duplicates(df, target=1.0).collect()
    assert len(found) == len(rows)
    assert sum(r.n_links for r in found) >= 0.99 * sum(count.values())
    assert all(r.n_links <= count.get(r.vec_id, 0) for r in found)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)
    assert sum(r.component_id == root[r.vec_id] for r in found) >= 0.99 * len(found)
    plain = {r.vec_id: r for r in found}
    assert all(plain[i].n_links == 0 and plain[i].component_id == i for i in (2000, 2001, 2002, 2003, 2004, 2005, 2007))
    assert plain[2006].n_links == count[2006] and plain[1000].n_links == count[1000]


def linked_pairs(n, pairs, dims, cosine, seed):
    """Random unit vectors of two labels, some of which have a partner of the given cosine."""
    draw = np.random.default_rng(seed)
    x = draw.standard_normal((n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = embeddings.at_threshold(x[:pairs], cosine, seed + 1)
    both = np.concatenate([x, y]).astype("f4")
    labels = np.concatenate([np.arange(n) % 2, np.arange(pairs) % 2])
    return [(i, v.tolist(), int(lab)) for i, (v, lab) in enumerate(zip(both, labels))]


@pytest.mark.parametrize("codewords", [8, 40, 96])
@pytest.mark.parametrize("pairs", [60, 2000])
def test_recall_at_several_codebook_sizes(spark, monkeypatch, codewords, pairs):
    """Few and many links just above the threshold: at least 0.9 of them found, as the contract asks."""
    rows = linked_pairs(3000, pairs, 64, 0.935, codewords)
    monkeypatch.setattr(embeddings, "fit", lambda groups, count, width, fit=embeddings.fit: fit(groups, 3 * 64 * codewords**2, width, 3 * 64 * codewords**2 * 4000 // 5000))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = {r.vec_id: r.n_links for r in embeddings.near_duplicates(df).collect()}
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    labels = np.array([lab for _, _, lab in rows])
    true = ((x @ x.T >= 0.93) & (labels[:, None] == labels)).sum(axis=1) - 1
    got = np.array([found[i] for i in range(len(rows))])
    assert true.sum() >= 1.9 * pairs and (got <= true).all() and got.sum() >= 0.93 * true.sum()


def test_ranks_go_on_past_the_first_look(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "_VISITS", 2)
    rows = linked_pairs(400, 400, 32, 0.935, 3)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    monkeypatch.setattr(embeddings, "_MOST_CODEWORDS", 12)
    monkeypatch.setattr(embeddings, "fit", lambda groups, count, width, fit=embeddings.fit: fit(groups, 10**6, width, 10**6))
    found = embeddings.near_duplicates(df).collect()
    assert sum(r.n_links for r in found) >= 0.93 * 800


def test_embeddings_query(spark):
    assert difference(queries.op9_embeddings(spark, "/root/testdata/sf0.01"), duck("/root/testdata/sf0.01"), ORACLE["op9_embeddings"]) is None


def test_embeddings_empty_and_repeated(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert embeddings.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    df = spark.createDataFrame([(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (None, [1.0, 2.0], 0), (2, [1.0, 2.001], 0)], schema)
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in embeddings.near_duplicates(df).collect()) == [(0, 0, 0), (1, 2, 1), (1, 2, 1), (2, 2, 1)]
