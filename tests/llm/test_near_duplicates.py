"""Operators on pairs against brute force: fingerprints, vectors, passages, components."""

import itertools
import math
import random
import re
import time
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from cellframe.core import shared_dir
from cellframe.llm import blocks, embeddings, passages, simhash
from cellframe.links import components

from .conftest import documents


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def test_components_of_paths_stars_and_pairs(spark):
    rng = random.Random(4)
    order = rng.sample(range(1000), 60)
    links = [*itertools.pairwise(order), *[(2000, 2001 + i) for i in range(150)], (5000, 5001), (7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "src long, dst long")).collect()}
    real = [x for x in links if None not in x and x[0] != x[1]]
    assert got == roots({n for x in real for n in x}, real)
    assert components(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_every_pair_of_a_bucket_meets_in_one_group(spark):
    rows = [(i, 1) for i in range(40)] + [(100, 2), (101, 2), (200, 3)]
    dealt = blocks.deal(spark.createDataFrame(rows, "id long, bucket long"), "id", least=6, most=6).collect()
    groups = {}
    for r in dealt:
        groups.setdefault((r.bucket, r.i, r.j), []).append(r)
    met = [
        tuple(sorted((a.id, b.id)))
        for (_, i, j), members in groups.items()
        for a, b in itertools.combinations(members, 2)
        if (i == j) or a.shard != b.shard
    ]
    expected = [*itertools.combinations(range(40), 2), (100, 101)]
    assert sorted(met) == sorted(expected)
    assert max(len(g) for g in groups.values()) < 30


def fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_by_definition(spark, odd):
    got = simhash.with_fingerprints(odd.select("doc_id", "text")).select("text", F.xxhash64("text").alias("x"), simhash.hex_digits(F.col("fingerprint")).alias("f")).collect()
    assert all(r.f == f"{fingerprint(r.text):016x}" for r in got) and len(got) == 12
    jvm = {r.text: r.x for r in got if r.text is not None}
    assert all(xxhash.xxh64(t.encode(), seed=42).intdigest() == x % 2**64 for t, x in jvm.items())


@pytest.mark.parametrize("bits", [0, 1, 3])
def test_trie_walk_finds_exactly_the_near_pairs(bits):
    rng = np.random.default_rng(bits)
    centres = rng.integers(0, 2**63, 12, dtype=np.uint64)
    values = [c ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False))) for c in centres for _ in range(25)]
    values = np.concatenate([np.array(values, np.uint64), rng.integers(0, 2**63, 200, dtype=np.uint64)])
    group = np.arange(len(values)) % 3
    order = np.lexsort((values, group))
    values, group = values[order], group[order]
    a, b = simhash.trie_pairs(values, blocks.group_starts(group), bits)
    expected = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if group[i] == group[j] and int(values[i] ^ values[j]).bit_count() <= bits}
    found = list(zip(a.tolist(), b.tolist(), strict=True))
    assert set(found) == expected and len(found) == len(expected)


def test_simhash_components_equal_brute_force(spark):
    rng = random.Random(1)
    base = [prose(rng, 120) for _ in range(12)]
    rows = []
    for k in range(150):
        w = rng.choice(base).split()
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
        rows.append((1000 - k, " ".join(w)))
    prints = simhash.with_fingerprints(documents(spark, rows), keep=["doc_id"])
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(prints).collect()}
    f = {i: fingerprint(t) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(f, 2) if (f[a] ^ f[b]).bit_count() <= 3]
    assert got == roots(f, links) and len(set(got.values())) < 150


def test_simhash_of_odd_rows(spark, odd, nothing):
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    # null, empty and blank texts are alike; so are equal texts, up to letter case
    assert ids.count(6) == 1 and 1 in ids and 2 not in ids and 3 not in ids and 5 in ids and 8 not in ids
    found = simhash.near_duplicates(simhash.with_fingerprints(odd, keep=["doc_id"]))
    assert found.count() == 12
    assert simhash.deduplicate(nothing).count() == 0


@pytest.mark.parametrize("most", [3, 8, 40, 200])
def test_hashes_of_the_sql_equal_the_library(most):
    import duckdb

    rng = random.Random(most)
    texts = pd.DataFrame({"s": sorted({"".join(rng.choices("aé漢b z😀", k=rng.randint(1, most))) for _ in range(100)})})
    con = duckdb.connect()
    con.register("texts", texts)
    found = con.execute(f"WITH {simhash._xxh64_sql('SELECT s FROM texts')} SELECT s, h FROM hashed").fetchall()
    assert len(found) == len(texts) and all(xxhash.xxh64_intdigest(s.encode(), simhash.SEED) == h for s, h in found)


def test_simhash_of_odd_rows_equals_its_sql(spark, odd):
    import duckdb

    con = duckdb.connect()
    con.register("documents", odd.select("doc_id", "text").toArrow())
    prints = simhash.with_fingerprints(odd.select("doc_id", "text"), keep=["doc_id"])
    found = simhash.near_duplicates(prints).select("doc_id", simhash.hex_digits(F.col("fingerprint")), "component_id")
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, con.execute(simhash.oracle_sql()).fetchall()))


def test_near_copies_go_as_by_exact_jaccard(spark):
    """Texts of 5-word similarity 0.8 or more whose fingerprints differ in far more than 3 bits."""
    rng = random.Random(12)
    rows = []
    for g in range(12):
        base = prose(rng, 150, 10_000).split()
        for _ in range(4):
            w = list(base)
            for at in rng.sample(range(5, 145), rng.randrange(1, 5)):
                w[at] = f"z{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(100, ""), (101, " "), (102, "one two"), (103, "ONE  two"), (104, "two one")]
    sets = {i: grams(t.lower().split()) or {tuple(t.lower().split())} for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    bits = {i: simhash.fingerprint(t, 5) & (2**64 - 1) for i, t in rows}
    assert sum((bits[a] ^ bits[b]).bit_count() > 3 for a, b in links) > 20
    got = {r.doc_id for r in simhash.deduplicate(documents(spark, rows)).collect()}
    assert got == set(roots(sets, links).values())


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 24))
    x = np.vstack([np.repeat(centres, 30, axis=0) + rng.normal(size=(240, 24)) * 0.12, rng.normal(size=(300, 24))]).astype(np.float32)
    x = np.vstack([x, x[:20]])
    ids = rng.permutation(len(x)) + 5
    rows = [(int(i), [float(v) for v in r], 0) for i, r in zip(ids, x, strict=True)]
    got = {r.vec_id: r for r in embeddings.near_duplicates(vectors(spark, rows)).collect()}
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    links = [(int(ids[a]), int(ids[b])) for a, b in zip(*np.nonzero(near), strict=True)]
    expected = roots([int(i) for i in ids], links)
    assert [got[int(i)].n_links for i in ids] == near.sum(1).tolist()
    assert {i: r.component_id for i, r in got.items()} == expected
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_hot_group_of_vectors_is_split_and_whole(spark, monkeypatch):
    monkeypatch.setattr(blocks, "LEAST_SHARD", 16)
    monkeypatch.setattr(embeddings, "deal", lambda rows, id_col, **how: blocks.deal(rows, id_col, **(how | {"least": 16, "most": 16})))
    rng = np.random.default_rng(6)
    x = rng.normal(size=12) + rng.normal(size=(90, 12)) * 0.01
    got = embeddings.near_duplicates(vectors(spark, [(i, [float(v) for v in r], 0) for i, r in enumerate(x)])).collect()
    assert {r.n_links for r in got} == {89} and {r.component_id for r in got} == {0}


def test_vectors_that_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [nan, 1.0], 0), (6, [inf, 1.0], 0), (7, [1.0, 1.0], 0)]
    rows += [(8, [2.0, 2.0], 0), (9, [1.0, 1.0, 0.0], 0), (None, [1.0, 1.0], 0), (7, [1.0, 1.0], 0), (10, [0.0, 0.0], 0), (11, [-0.0, 3.0], 0), (12, [0.0, 3.0], 0)]
    got = [(r.vec_id, r.n_links, r.component_id) for r in embeddings.near_duplicates(vectors(spark, rows)).collect()]
    one = {g[0]: g[1:] for g in got if g[0] is not None}
    assert len(got) == len(rows) and (None, 0, None) in got
    assert all(one[i] == (0, i) for i in (1, 2, 3, 4, 5, 6, 9, 10))
    assert one[7] == (1, 7) and one[8] == (1, 7) and one[11] == (1, 11) and one[12] == (1, 11)
    assert embeddings.near_duplicates(vectors(spark, [])).count() == 0


def test_recall_at_the_threshold_is_high():
    d, n = 64, 50_000
    k, signs = embeddings.table_plan(d, n, 0.95, 0.999, 17)
    rng = np.random.default_rng(99)
    a = rng.normal(size=(2000, d))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(2000, d))
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    ka, kb = embeddings.bucket_keys(a, signs, k), embeddings.bucket_keys(b, signs, k)
    assert (ka[:, :, :, None] == kb[:, :, None, :]).any(axis=(1, 2, 3)).mean() > 0.98


def test_hadamard_is_orthogonal():
    h = embeddings.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16)) and np.allclose(np.abs(h), 0.25)


def grams(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_paragraphs_cluster_as_by_exact_jaccard(spark):
    rng = random.Random(8)
    base = [prose(rng, 80).split() for _ in range(10)]
    rows = []
    for d in range(80):
        lines = [prose(rng, 60)]
        w = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(1000)}"
        lines.insert(rng.randrange(2), " ".join(w))
        rows.append((d, "\n".join(lines)))
    found = [r for r in passages.find_repeats(documents(spark, rows)).collect() if r.unit == "paragraph"]
    got = {(r.doc_id, r.start_word): (r.cluster_doc, r.cluster_start) for r in found}
    places = {}
    for d, t in rows:
        at = 0
        for line in t.split("\n"):
            places[d, at] = grams(line.split())
            at += len(line.split())
    links = [(a, b) for a, b in itertools.combinations(sorted(places), 2) if len(places[a] & places[b]) >= 0.8 * len(places[a] | places[b])]
    expected = roots(places, links)
    clusters = {k: v for k, v in expected.items() if list(expected.values()).count(v) > 1}
    assert got == clusters
    assert sum(r.kept for r in found) == len(set(clusters.values()))


def test_settling_within_tasks_equals_all_pairs(spark, monkeypatch):
    """Members unlike their band's least one are still linked with one another."""
    monkeypatch.setattr(passages, "SHARD", 4)
    rng = random.Random(3)
    one, two = prose(rng, 120).split(), prose(rng, 120).split()
    mixed = one[:70] + two[:50]  # shares bands with both, is like neither
    texts = [mixed, *[[*one[:i], f"u{i}", *one[i + 1 :]] for i in range(0, 100, 9)], *[[*two[:i], f"v{i}", *two[i + 1 :]] for i in range(0, 100, 9)]]
    found = passages.find_repeats(documents(spark, [(i, " ".join(w)) for i, w in enumerate(texts)]))
    got = {r.doc_id: r.cluster_doc for r in found.where("unit = 'paragraph'").collect()}
    sets = [grams(w) for w in texts]
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    expected = {k: v for k, v in roots(range(len(texts)), links).items() if k in {x for p in links for x in p}}
    assert got == expected


def test_shared_passages_inside_lines_are_found_and_removed(spark):
    rng = random.Random(9)
    shared = prose(rng, 55, 10_000)
    rows = [(i, f"{prose(rng, 40 + i, 10_000)} {shared} {prose(rng, 90, 10_000)}") for i in range(6)] + [(50 + i, prose(rng, 200, 10_000)) for i in range(20)]
    docs = documents(spark, rows)
    found = passages.find_repeats(docs)
    got = found.collect()
    # a window near an edge may be recorded in some documents only: then the first of these names it
    assert {r.doc_id for r in got if r.cluster_doc == 0} == {r.doc_id for r in got} == set(range(6))
    assert all(40 + r.doc_id <= r.start_word and r.end_word <= 95 + r.doc_id for r in got)
    left = {r.doc_id: r.text for r in passages.remove_repeats(docs, found).collect()}
    assert left[0] == rows[0][1] and len(left[3].split()) < len(rows[3][1].split()) - 25 and left[55] == rows[11][1]


def test_passages_are_reported_to_their_ends(spark):
    rng = random.Random(19)
    rows = []
    for g in range(8):
        shared = prose(rng, 51 + 4 * g, 10**6)
        rows += [(2 * g + k, f"{prose(rng, 60 + 7 * k, 10**6)} {shared} {prose(rng, 90, 10**6)}") for k in range(2)]
    docs = documents(spark, rows)
    found = passages.find_repeats(docs)
    got = {(r.doc_id, r.start_word, r.end_word, r.cluster_doc, r.cluster_start, r.kept) for r in found.collect()}
    assert got == {(2 * g + k, 60 + 7 * k, 111 + 4 * g + 7 * k, 2 * g, 60, k == 0) for g in range(8) for k in range(2)}
    left = {r.doc_id: len(r.text.split()) for r in passages.remove_repeats(docs, found).collect()}
    assert all(left[2 * g + 1] == 157 for g in range(8))


def test_repeats_leave_little_on_disk(spark):
    """Neither units nor shuffle files outlive their use; what is left can be read again and again."""
    rng = random.Random(23)
    shared = prose(rng, 60, 10**6)
    docs = documents(spark, [(i, f"{prose(rng, 70, 10**6)}\n{prose(rng, 40 + i, 10**6)} {shared} {prose(rng, 90, 10**6)}") for i in range(20)])
    folder, manager = Path(shared_dir(spark).removeprefix("file:"), "cellframe"), spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def shuffled():
        files = manager.getAllFiles()
        return {files.apply(k).getName() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_")}

    tables, shuffles, setting = set(folder.glob("*")), shuffled(), dict(spark.conf.getAll)
    found = passages.find_repeats(docs)
    left = {x.name.split("-")[0] for x in set(folder.glob("*")) - tables}
    assert {"repeats", "passages", "far"} <= left and not left & {"units", "ends", "edges"}
    late = time.monotonic() + 5
    while shuffled() - shuffles and time.monotonic() < late:
        time.sleep(0.1)
    assert not shuffled() - shuffles
    assert {k: v for k, v in spark.conf.getAll.items() if "fileCleanup" in k} == {k: v for k, v in setting.items() if "fileCleanup" in k}
    first = sorted(found.collect())
    assert {r.doc_id for r in first} == set(range(20)) and first == sorted(found.collect())


def test_winnowing_keeps_its_promise():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 2**63, 400, dtype=np.uint64)
    at = passages.winnow(h)
    assert np.diff(np.concatenate([[-1], at, [400]])).max() <= passages.SLIDE
    same = passages.winnow(np.full(300, 7, np.uint64))
    assert len(same) <= 300 // passages.SLIDE + 1 and np.diff(same).max() <= 2 * passages.SLIDE


def test_run_hashes_depend_on_the_run_alone():
    rng = np.random.default_rng(1)
    w = rng.integers(0, 2**63, 50, dtype=np.uint64)
    v = np.concatenate([rng.integers(0, 2**63, 9, dtype=np.uint64), w])
    assert (passages.run_hashes(w, 5) == passages.run_hashes(v, 5)[9:]).all()
    assert len(passages.run_hashes(w[:4], 5)) == 0


def test_passages_of_odd_rows(spark, odd, nothing):
    twice = odd.where("doc_id = 7").unionByName(odd)  # a repeated row alone is no repeat across documents
    assert {r.doc_id for r in passages.find_repeats(twice).collect()} <= {7}
    assert passages.find_repeats(nothing).count() == 0
    again = odd.where("doc_id = 7").withColumn("doc_id", F.lit(70).cast("long")).unionByName(odd)
    got = passages.find_repeats(again).collect()
    assert {r.doc_id for r in got} == {7, 70} and all(r.kept == (r.doc_id == 7) for r in got)


def test_rows_of_one_id_are_judged_each_by_its_text(spark):
    """A near copy goes, a clean text that shares its id stays; of equal rows one stays, whatever their order."""
    rng = random.Random(21)
    a, b, c = (prose(rng, 80, 10_000) for _ in range(3))
    rows = [(2, a), (6, a), (6, b), (9, c), (9, c.upper()), (None, a), (None, b), (8, None), (8, "")]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame([(i, t, {"k": i or 0}) for i, t in order], "doc_id long, text string, h map<string,long>")
        kept = simhash.deduplicate(docs)
        assert kept.columns == docs.columns
        got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
        assert got == sorted([(2, a), (6, b), (9, c.upper()), (None, a), (None, b), (8, None)], key=str)


@pytest.mark.parametrize("words", [5, 10, 19, 20, 25, 29, 30, 45, 49, 50, 60])
def test_every_copy_of_a_paragraph_is_found(spark, words):
    rng = random.Random(words)
    shared = prose(rng, words, 10**6)
    rows = [(i, f"{prose(rng, 5 + i % 60, 10**6)}\n{shared}\n{prose(rng, 8, 10**6)}") for i in range(40)]
    rows += [(100 + i, shared) for i in range(3)]
    docs = documents(spark, rows)
    found = passages.find_repeats(docs, least_words=min(words, passages.LEAST_EXACT))
    got = {(r.doc_id, r.start_word): (r.cluster_doc, r.cluster_start, r.kept) for r in found.where("unit = 'paragraph'").collect()}
    assert got == {**{(i, 5 + i % 60): (0, 5, i == 0) for i in range(40)}, **{(100 + i, 0): (0, 5, False) for i in range(3)}}
    if words < passages.LEAST_EXACT:
        assert passages.find_repeats(docs).count() == 0


def test_removal_leaves_what_is_no_repeat(spark, odd, nothing):
    schema = "doc_id long, unit string, start_word int, end_word int, cluster_doc long, cluster_start int, kept boolean"
    rng = random.Random(31)
    texts = {i: "\n".join(" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(9))) + "  " * rng.randrange(2) for _ in range(rng.randrange(6))) for i in range(40)}
    spans = {i: [(a, a + rng.randrange(1, 7)) for a in (rng.randrange(25) for _ in range(rng.randrange(5)))] for i in texts}
    repeats = spark.createDataFrame([(i, "passage", a, b, 99, 0, False) for i, x in spans.items() for a, b in x] + [(3, "passage", 0, 50, 3, 0, True)], schema)
    docs = documents(spark, list(texts.items())).withColumn("spans", F.lit("x")).withColumn("_gone", F.lit(1)).withColumn("cut", F.lit(None).cast("string"))
    left = passages.remove_repeats(docs, repeats)
    assert left.columns == docs.columns
    for r in left.collect():
        out, low = [], 0
        for line in texts[r.doc_id].split("\n"):
            words = line.split()
            keep = [w for k, w in enumerate(words) if not any(a <= low + k < b for a, b in spans[r.doc_id])]
            out += [line] if len(keep) == len(words) else [" ".join(keep)] if keep else []
            low += len(words)
        assert r.text == "\n".join(out)
    again = passages.remove_repeats(odd, repeats.where("doc_id = 7"))
    assert again.count() == odd.count() and passages.remove_repeats(nothing, repeats).count() == 0


def test_bands_rarely_lose_a_pair_before_it_is_compared():
    """What AGREE asks of the MinHash values is missed by a pair of similarity 0.8 once in 10,000 times or less."""
    n = passages.BANDS * passages.ROWS
    missed = sum(math.comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(passages.AGREE))
    assert missed < 1e-4
    rng = np.random.default_rng(3)
    lost = 0
    for _ in range(2000):
        common, own = rng.integers(0, 2**32, 80, dtype=np.uint32), rng.integers(0, 2**32, 20, dtype=np.uint32)
        signs = passages.signatures(np.concatenate([common, own[:10], common, own[10:]]), np.array([0, 90]))
        lost += int((signs[0] == signs[1]).sum() < passages.AGREE)
    assert lost <= 2
