"""SimHash groups, hard negatives and the Merkle manifest against brute force, and their edge cases."""

import hashlib
import inspect
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash
from conftest import DATA
from pyspark.sql import functions as F

from trajspark.llm import hard_negatives, licences, merkle, packing, simhash, toxicity
from trajspark.llm.mixing import OP3_SQL
from trajspark.llm.quality import OP9_SQL

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, fp string, digest string, idx long, tree string"
LONG = "alpha beta gamma delta " * 30_000
ODD = [
    (1, None, "s0"), (2, "", None), (3, " \t\n ", "s1"), (4, "one", "s1"), (5, "a b c d e\nf g h i j k l", "s1"), (5, "a b c d e\nf g h i j k l", "s1"),
    (6, "x <|endoftext|> y  z\x1c é日本😀's don't", "é"), (7, LONG, "s2"), (None, "no id at all\nbut some words in it", None), (8, "A B C D E F G H I J K L", "s1"), (5, "other\n\nwords", "s1"), (None, None, None), (9, "one\n", ""),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, None if r[0] == 4 else "en", 7 if r[0] != 3 else None, "x", "y", 3, "z") for r in ODD], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# -- SimHash


def brute_fingerprint(text, n=3):
    words = [w for w in (text or "").translate({c: " " for c in range(9, 14)}).translate({c: c + 32 for c in range(65, 91)}).split(" ") if w]
    if not words:
        return 0
    k = min(n, len(words))
    hashes = [xxhash.xxh64(" ".join(words[i : i + k]).encode(), 42).intdigest() for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows, radius=3):
    """Rows of (doc_id, fingerprint) with the least id within reach, by flooding."""
    at, seen, found = {}, set(), {}
    for i, fp in rows:
        at.setdefault(fp, []).append(i)
    for fp in at:
        if fp in seen:
            continue
        group, waiting = [], [fp]
        seen.add(fp)
        while waiting:
            x = waiting.pop()
            group.append(x)
            near = [y for y in at if y not in seen and bin(x ^ y).count("1") <= radius]
            seen.update(near)
            waiting += near
        least = min((i for g in group for i in at[g] if i is not None), default=None)
        found |= dict.fromkeys(group, least)
    return sorted(((i, f"{fp:016x}", found[fp]) for i, fp in rows), key=str)


def test_simhash_query(spark):
    docs = pd.read_parquet(f"{DATA}/documents.parquet")
    want = brute_groups([(i, brute_fingerprint(t)) for i, t in zip(docs.doc_id, docs.text, strict=True)])
    got = simhash.op11_simhash_near_dedup(spark, DATA).collect()
    assert sorted(map(tuple, got), key=str) == want
    assert len({r[2] for r in want}) < len(want)


def test_simhash_edges(spark, odd, empty):
    want = brute_groups([(r[0], brute_fingerprint(r[1])) for r in ODD])
    assert sorted(map(tuple, simhash.simhash_components(odd).collect()), key=str) == want
    assert simhash.simhash_components(empty).count() == 0


def test_simhash_groups_of_near_copies(spark, monkeypatch):
    """Fingerprints in chains and balls, over several tiles and runs."""
    rnd, fps = random.Random(5), []
    for size in (1, 2, 40, 300):
        at = rnd.getrandbits(64)
        for _ in range(size):
            fps.append(at)
            for b in rnd.sample(range(64), rnd.randint(1, 3)):
                at ^= 1 << b
    fps += [fps[-1] ^ sum(1 << b for b in rnd.sample(range(64), 2)) for _ in range(200)] + [rnd.getrandbits(64) for _ in range(300)] + [0, 1, (1 << 64) - 1]
    rows = list(enumerate(fps))
    rnd.shuffle(rows)
    want = brute_groups(rows)
    for tile, run in ((16_384, 256), (8, 3)):
        monkeypatch.setattr(simhash, "TILE", tile)
        monkeypatch.setattr(simhash, "RUN", run)
        values = np.array(sorted(set(fps)), np.uint64)
        a, b = simhash.linked(values, None, 3)
        assert len(a) < len(values)
        assert brute_groups_of(values.tolist(), a.tolist(), b.tolist()) == brute_groups_of(values.tolist(), *zip(*[(x, y) for x in values.tolist() for y in values.tolist() if bin(x ^ y).count("1") <= 3], strict=True))
    groups = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in set(fps)], "fp long")
    pairs = simhash._tile_pairs(groups, 3)
    assert pairs.groupBy("a", "b").count().where("count > 2").count() == 0
    links = pairs.groupBy("a", "b").applyInArrow(simhash._compare(3), "a long, b long").collect()
    links = [(int(np.int64(r.a).view(np.uint64)), int(np.int64(r.b).view(np.uint64))) for r in links]
    assert all(bin(x ^ y).count("1") for x, y in links)
    named = {f: c for _, f, c in want}
    got = brute_groups_of(sorted(set(fps)), *zip(*links, strict=True))
    assert len(set(got.values())) == len(set(named.values()))


def brute_groups_of(values, a, b):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for x, y in zip(a, b, strict=True):
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


# -- hard negatives


def brute_mined(rows, is_anchor, positives=5, negatives=10, band=(30, 90)):
    v = {}
    for i, label, x in rows:
        if i is None or label is None or x is None or any(c is None or not np.isfinite(c) for c in x):
            continue
        z = [int(np.floor(256 * float(c))) for c in x]
        key = (label, np.array(z, "<f8").tobytes(), z)
        v[i] = min(v.get(i, key), key)
    out = []
    for a in filter(is_anchor, v):
        score = {b: sum(p * q for p, q in zip(v[a][2], v[b][2], strict=False)) for b in v if b != a}
        best = sorted(score, key=lambda b: (-score[b], b))
        for p in [b for b in best if v[b][0] == v[a][0]][:positives]:
            found = [b for b in best if v[b][0] != v[a][0] and band[0] * score[p] <= 100 * score[b] <= band[1] * score[p]]
            out += [(a, p, k + 1, b, score[p], score[b]) for k, b in enumerate(found[:negatives])]
    return sorted(out)


def vectors(seed, n, dim, labels=3, spread=0.6):
    rnd = np.random.default_rng(seed)
    middle = rnd.normal(size=(labels, dim))
    label = rnd.integers(0, labels, n)
    x = (middle[rnd.integers(0, labels, n)] + spread * rnd.normal(size=(n, dim))) / 4
    return [(int(i), int(c), [float(np.float32(y)) for y in r]) for i, c, r in zip(range(n), label, x, strict=True)]


VECTORS = "vec_id long, label int, embedding array<float>, v string, cluster int"


@pytest.mark.parametrize(("members", "anchors", "shard", "step"), [(48, 8192, 32_768, 256), (4, 7, 50, 16)])
def test_hard_negatives(spark, monkeypatch, members, anchors, shard, step):
    for name, value in (("MEMBERS", members), ("ANCHORS", anchors), ("SHARD", shard), ("FIRST_STEP", step), ("STEP", 4 * step)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = vectors(1, 700, 6)
    rows += [(1000 + i, c, x) for i, c, x in rows[:60]]  # ties
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS).repartition(5)
    got = hard_negatives.mine_hard_negatives(df, F.col("vec_id") % 20 == 0).collect()
    assert sorted(map(tuple, got)) == brute_mined(rows, lambda i: i % 20 == 0)


def test_hard_negatives_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 0.5]), (0, 1, [1.0, 0.5]), (0, 2, [9.0, 9.0]), (1, 1, [0.9, 0.4]), (2, 1, [0.0, 0.0]), (3, 2, [0.5, 0.5]), (4, 2, [0.5, 0.5]), (5, 2, [-1.0, -1.0]), (6, None, [1.0, 1.0]), (7, 2, None), (8, 2, [nan, 1.0]), (9, 2, [inf, 1.0]),
        (10, 2, [None, 1.0]), (None, 2, [0.6, 0.5]), (20, 3, [0.0, 0.0]), (30, 3, [-0.1, 0.2]), (40, 5, [1.0]), (50, 5, [1.0, 2.0]), (60, 6, []), (61, 6, [0.3, 0.1]), (-10, 2, [0.7, 0.2]), (62, 7, [0.7, 0.2]), (70, 6, [3e6, 1e6]), (71, 6, [2e6, 1e6]), (72, 1, [1e6, 1e6]),
    ]
    filled = [(i, c, x if x is None else [*x, 0.0, 0.0][:2]) for i, c, x in rows]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS).repartition(3)
    got = sorted(map(tuple, hard_negatives.mine_hard_negatives(df, F.col("vec_id") % 10 == 0).collect()))
    assert got == brute_mined(filled, lambda i: i % 10 == 0) and got
    none = spark.createDataFrame([], VECTORS)
    assert hard_negatives.mine_hard_negatives(none, F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives.mine_hard_negatives(df, F.col("vec_id") == 12345).count() == 0


def test_walk_ends_early():
    """On anchors that lie close together and near few candidates, most of the list is not scored."""
    rnd = np.random.default_rng(3)
    x = np.floor(256 * rnd.normal(size=(20_000, 8)) / 3)
    near = np.floor(x[:1] + 4 * rnd.normal(size=(30, 8)))
    side = lambda v, at: {"v": v, "x": v.astype(np.float32), "id": at + np.arange(len(v)), "label": np.zeros(len(v), np.int64)}
    candidates, anchors = side(np.r_[x, near + 1], 1000), side(near, 0)
    candidates["unit"], candidates["length"] = hard_negatives.unit(candidates["v"])
    taken = []

    class Counting(hard_negatives.Walk):
        def take(self, members, scores, ids, not_ids):
            taken.append(scores.size)
            super().take(members, scores, ids, not_ids)

    whole = np.iinfo(np.int64)
    start = lambda mine, _: Counting(np.arange(len(mine)), np.full(len(mine), whole.min), np.full(len(mine), whole.max), 5)
    ((walk, _),) = hard_negatives.walk_cluster(start, anchors, candidates, True)
    scores = near @ candidates["v"].T
    for i in range(30):
        order = np.lexsort((candidates["id"], -scores[i]))[:5]
        assert walk.found[2][walk.found[0] == i].tolist() == candidates["id"][order].tolist()
    assert sum(taken) < scores.size / 5


# -- Merkle manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute_tree(nodes, fan):
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, k in zip(paths, at, strict=True):
            run = k // fan * fan
            path.append(("".join(nodes[run:k]), "".join(nodes[k + 1 : run + fan])))
        at, nodes = [k // fan for k in at], [digest(*nodes[i : i + fan]) for i in range(0, len(nodes), fan)]
    return nodes[0], paths


def brute_manifest(rows, fan=3):
    """rows: doc_id, source, lang, n_chars, text."""
    trees = {}
    for i, source, lang, n, text in rows:
        other = text if text is None or i is None or zlib.crc32(str(i).encode()) % 2 else text.replace("\n", "")
        trees.setdefault(source, []).append((i, *(digest(*map(brute_field, (i, source, lang, n, t))) for t in (text, other))))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        trees[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    made = {s: brute_tree([x[1] for x in trees[s]], fan) for s in names}
    root, above = brute_tree([made[s][0] for s in names], fan)
    out = []
    for s, up in zip(names, above, strict=True):
        for (i, leaf, other), path in zip(trees[s], made[s][1], strict=True):
            folded = other
            for before, after in [*path, *up]:
                folded = digest(before, folded, after)
            out.append((i, leaf, made[s][0], root, digest(*(a + b for a, b in [*path, *up])), folded, folded == root))
    return out


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]


def test_merkle_query(spark):
    got = merkle.op13_merkle_manifest(spark, DATA)
    want = brute_manifest(rows_of(spark.read.parquet(f"{DATA}/documents.parquet")))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert {r[-1] for r in want} == {True, False}


@pytest.mark.parametrize("fan", [2, 3, 5])
def test_merkle_edges(spark, odd, empty, fan):
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    made = merkle.merkle_manifest(odd, changed={"text": tampered}, fan=fan)
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    got = made.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256), merkle.refolded(F.col("changed"), F.col("path")).alias("f")).withColumn("v", F.col("f") == F.col("root"))
    # equal rows have equal leaves, but a place each
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_manifest(rows_of(odd), fan), key=str)
    assert merkle.merkle_manifest(empty, fan=fan).count() == 0
    one = odd.where("doc_id = 7")
    (r,) = merkle.merkle_manifest(one, fan=fan).collect()
    assert r.leaf == r.subroot == r.root == r.changed and r.path == []


def test_merkle_plan(spark):
    """The plan of the proofs does not grow with the height of the trees."""
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit("en").alias("lang"), F.lit(1).alias("n_chars"), F.lit("x").alias("text"))
    for few in (4, 300):
        made = merkle.merkle_manifest(df.where(F.col("doc_id") < few))
        assert made._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 2
        assert made.count() == few


def test_merkle_numbers(spark):
    """Numbers of rows in a hot tree, among many trees and repeated rows."""
    rows = [("hot", i // 3) for i in range(3000)] + [(None, 1), (None, None)] + [(f"t{i}", 0) for i in range(40)]
    df = spark.createDataFrame(rows, "tree string, k long").repartition(7)
    got = merkle.numbered(df, "tree", ["k"]).collect()
    by_tree = {}
    for r in got:
        by_tree.setdefault(r.tree, []).append((r.idx, r.n, r.k))
    for found in by_tree.values():
        found.sort()
        assert [x[0] for x in found] == list(range(len(found))) and {x[1] for x in found} == {len(found)}
        keys = [-1 if x[2] is None else x[2] for x in found]
        assert keys == sorted(keys)
    assert len(got) == len(rows)


# -- packing


@pytest.mark.parametrize("kind", ["uniform", "lognormal"])
def test_packing_of_more_pieces_than_open_bins(kind):
    """Windows of 16,384 arrivals, as pack_documents takes them: within 1% of the least number of bins."""
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 1025, 130_000) if kind == "uniform" else np.clip(rng.lognormal(5.9, 0.8, 130_000).astype(int), 1, 1024)
    defaults = inspect.signature(packing.pack_documents).parameters
    bins = packing.OpenBins(1024, defaults["open_bins"].default)
    window = defaults["window"].default
    for start in range(0, len(lengths), window):
        for n in sorted(lengths[start : start + window].tolist(), reverse=True):
            bins.place(n)
    assert bins.bins <= 1.01 * -(-lengths.sum() // 1024)
    assert bins.open <= 16_384 and bins.closed <= bins.bins
    few = packing.OpenBins(10, 1)
    assert [few.place(n)[0] for n in (6, 7, 3)] == [0, 1, 1] and few.closed == 1


# -- licences


#: Not among what the classifier learns from: statements with their family, and texts that state none.
STATED = [
    ("Apache", "This module is licensed under the Apache License, Version 2.0, as its other parts are."), ("Apache", "Code of the tests: licensed under the Apache License, version 2.0"), ("MIT", "The library is released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person who obtains a copy of this software and its associated documentation files."), ("BSD", "The scripts are released under the BSD License"), ("GPL", "These tools are licensed under the GNU General Public License, version 3."),
    ("LGPL", "This small library is licensed under the GNU Lesser General Public License, version 2.1 or later."), ("AGPL", "The server program is licensed under the GNU Affero General Public License, version 3."), ("MPL", "All of it is released under the Mozilla Public License, version 2.0."),
    ("ISC", "This package is released under the ISC License."), ("EPL", "The program and accompanying materials are made available under the Eclipse Public License 2.0"), ("CC-BY", "These photos are licensed under CC BY 4.0."), ("CC-BY-SA", "The text is licensed under CC BY-SA 4.0."), ("public domain", "This map is dedicated to the public domain."),
]
UNSTATED = [
    "This program is not licensed under the Apache License, Version 2.0.", "The software is not released under the MIT License.", "He moved to public domain works; dedicated to the public domain of art.", "The author released under the BSD License a driver in 1992, says the historian.",
    "The code was never released under the MIT License.", "These files are no longer licensed under the GNU General Public License, version 3.", "The court asked whether the work is dedicated to the public domain.", "The historian says that the driver was released under the BSD License in 1992.",
]


@pytest.fixture(scope="module")
def licence_model(spark):
    return licences.train_licences(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"))


def test_licences_held_out(spark, licence_model):
    """Precision and recall of paraphrases, denials and reports; without the classifier, templates pass all of these."""
    rows = [(i, f"the cat sat on the mat\n\n{t}\n\nand slept until noon") for i, t in enumerate([t for _, t in STATED] + UNSTATED)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = licences.licences_of_documents(table, licence_model).toPandas().set_index("doc_id")["families"]
    right = sum(got[i] == f for i, (f, _) in enumerate(STATED))
    wrong = sum(bool(got[i]) and got[i] != f for i, (f, _) in enumerate(STATED)) + sum(bool(got[len(STATED) + i]) for i in range(len(UNSTATED)))
    assert [got[len(STATED) + i] for i in range(4)] == [""] * 4
    assert right >= 0.85 * len(STATED) and right / (right + wrong) >= 0.85, got.tolist()
    off = licence_model._replace(bias=[-100.0, *licence_model.bias[1:]], threshold=0.0)
    unchecked = licences.licences_of_documents(table, off).toPandas().set_index("doc_id")["families"]
    assert sum(bool(unchecked[len(STATED) + i]) for i in range(len(UNSTATED))) > len(UNSTATED) / 2


def test_licences_in_documents(spark, licence_model):
    """The lines of notices in the documents are found as before denials and reports were learned."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = licences.licences_of_documents(docs, licence_model).toPandas()
    assert (got["n_licences"] > 0).sum() >= 35 and len(got) == docs.count()


def test_licences_learn_from_all_documents(spark):
    """The model and its threshold are of all documents, also of those that a sample by their ids' digests leaves out."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit("5:"), F.col("doc_id").cast("string"))), 1, 8), 16, 10).cast("double") / 2.0**32
    df = spark.range(2_000).select(F.col("id").alias("doc_id"))
    plain, other = "the cat sat on the mat", "the license of a public moon and of other stars"
    one, two = (licences.train_licences(df.withColumn("text", F.when(u >= 0.5, F.lit(t)).otherwise(F.lit(plain)))) for t in (plain, other))
    assert abs(one.bias[0] - two.bias[0]) > 1e-3 and one.weights != two.weights
    few = spark.createDataFrame([(x / 10,) for x in range(9)], "p double")
    whole = few.union(spark.range(91).select(F.lit(1.0)))
    assert licences._low_quantile(few, 100) == pytest.approx(whole.agg(F.percentile("p", F.lit(licences.FALSE_RATE))).first()[0])
    assert licences._low_quantile(few.where("p < 0"), 50) == 1.0 and licences._low_quantile(few, 0) is None


@pytest.mark.parametrize("name", ["version", "place", "run", "family", "probability"])
def test_licences_with_any_id_column(spark, licence_model, name):
    """Ids of any name; repeated rows, one id with two texts, null ids and ties."""
    rows = [(1, "Released under the MIT License."), (1, "Released under the MIT License."), (2, "Licensed under CC BY 4.0."), (2, "SPDX-License-Identifier: MIT"), (None, "Released under the MIT License."), (3, None), (4, "")]
    table = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], f"{name} long, text string, block long, words string")
    got = {r[name]: (r["families"], r["n_licences"]) for r in licences.licences_of_documents(table, licence_model, name).collect()}
    assert got == {1: ("MIT", 1), 2: ("CC-BY,MIT", 2), 3: ("", 0), 4: ("", 0)}
    hits = licences.scan_licences(table, licence_model, name)
    assert len(hits.columns) == len(set(hits.columns)) and hits.select(name).distinct().count() == 2


# -- pipeline


def test_pipeline_stages_by_brute_force(spark):
    """What every stage keeps, by SQL of its operator or by explicit sums, on its own input."""
    import corpus_pipeline as cp
    import duckdb

    def sql(frame, text):
        con = duckdb.connect()
        con.register("documents", frame)
        return con.sql(text).df()

    frames = [spark.read.parquet(f"{DATA}/documents.parquet")]
    for _, stage in cp.STAGES[:4]:
        frames.append(spark.createDataFrame(stage(spark, frames[-1], DATA).toPandas(), frames[0].schema))
    docs, first, clean, near, mixed = (f.toPandas() for f in frames)
    kept = sql(docs, OP9_SQL)
    assert sorted(first["doc_id"]) == sorted(kept[kept["kept"]]["doc_id"]) and len(first) < len(docs)
    # the factorization machine, every pair of a text's terms by itself
    model = toxicity.train_toxicity(frames[1], spark.read.parquet(f"{DATA}/labels.parquet"), ~toxicity.held_out())
    place = {int(p): i for i, p in enumerate(model.places)}
    want = []
    for i, text in zip(first["doc_id"], first["text"], strict=True):
        at = [place[h] for h in map(toxicity.hashed, toxicity.terms(text)) if h in place]
        pairs = sum(float(model.factors[a] @ model.factors[b]) for k, a in enumerate(at) for b in at[k + 1 :])
        if model.bias + sum(model.linear[a] for a in at) + pairs < 0:
            want.append(i)
    assert sorted(clean["doc_id"]) == sorted(want)
    groups = brute_shingle_groups(clean, 5, 0.8)
    assert sorted(near["doc_id"]) == sorted(set(groups.values()))
    taken = sql(near, OP3_SQL)
    copies = {r.doc_id: int(r.taken / r.size + 0.5) for r in taken.itertuples() if r.size}
    assert sorted(mixed["doc_id"]) == sorted(i for i, n in copies.items() for _ in range(n))


def brute_shingle_groups(docs, n, least):
    sets = {}
    for i, text in zip(docs["doc_id"], docs["text"], strict=True):
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.split(r"[ \t\n\x0b\f\r]+", text or "") if x]
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]
    a, b = zip(*links, strict=True) if links else ((), ())
    return brute_groups_of(sorted(sets), a, b)


def test_search_answers_a_shard_once(tmp_path, monkeypatch):
    """What a shard gave a query in the first pass, it doesn't look up or send again in the second."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from trajspark.llm import search

    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr(search, "TaskContext", Task)
    rows = next(iter(search._term_rows([pa.record_batch({"doc_id": [7, 3, 5], "text": ["one two three", "two", "four one one"]})])))
    rows = rows.append_column("row", pa.array([10, 11, 12]))
    asked = {"query_id": [7, 3], "digest": [0, 1], "terms": [rows.column("terms")[i].as_py() for i in (0, 1)], "idfs": [[1.0] * 3, [1.0]]}
    pq.write_table(pa.table(asked), tmp_path / "a.parquet")
    first = pa.Table.from_batches(search._search(f"file://{tmp_path}", 2, 7 / 3, 1)(iter([rows]))).to_pylist()
    assert [(r["query_id"], r["row"], r["doc_id"]) for r in first] == [(7, 10, 7), (7, 11, 3), (3, 11, 3), (3, 10, 7)]
    lists = pa.array([[first[0]["shard"]], []], pa.list_(pa.int64()))
    pq.write_table(pa.table(asked | {"least": [-np.inf] * 2, "shards": lists}), tmp_path / "a.parquet")
    second = pa.Table.from_batches(search._search(f"file://{tmp_path}", 2, 7 / 3, None)(iter([rows]))).to_pylist()
    assert second == first[2:]


def test_search_small_row_groups(spark):
    """Rows are written in groups of few bytes, so that pieces of files have like shares of them."""
    import pyarrow.parquet as pq

    from trajspark.llm.common import materialise

    wide = spark.range(20_000).select("id", F.sequence(F.col("id"), F.col("id") + 30).alias("a")).coalesce(1)
    files = materialise(wide, options={"parquet.block.size": 100_000, "parquet.enable.dictionary": "false"}).inputFiles()
    assert sum(pq.ParquetFile(f.removeprefix("file://")).num_row_groups for f in files) > 5


def test_search_of_like_documents(monkeypatch):
    """In two languages in one shard, what is frequent in one of them is a product of matrices for its queries;
    few postings of lists are added. Results are those of whole scores, with and without a threshold."""
    from trajspark.llm import search

    rng = np.random.default_rng(6)
    n = 2400
    rows = [np.unique(rng.zipf(1.3, rng.integers(20, 300)).clip(max=3000) * 7919 + (i % 3 == 0) * (1 << 40), return_counts=True) for i in range(n)]
    lens = np.array([r[1].sum() for r in rows])
    terms, tfs = (np.concatenate([r[i] for r in rows]).astype(np.int64) for i in (0, 1))
    doc = np.repeat(np.arange(n), [len(r[0]) for r in rows])
    places, of = np.unique(terms, return_inverse=True)
    df = np.bincount(of)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    whole = idf[of] * tfs * (search.K1 + 1) / (tfs + search.K1 * (1 - search.B + search.B * lens[doc] / lens.mean()))
    shard = search.Shard(np.arange(n), lens, np.r_[0, np.cumsum([len(r[0]) for r in rows])], terms, tfs, lens.mean())
    added, add = [], search.Shard._add
    monkeypatch.setattr(search.Shard, "_add", lambda self, sums, at, length, *a: added.append(int(length.sum())) or add(self, sums, at, length, *a))
    asked, want = [], []
    for i in range(0, n, 5):
        mine = np.isin(of, of[doc == i])
        scores = np.bincount(doc[mine], whole[mine], minlength=n)
        best = sorted(range(n), key=lambda d: (-round(scores[d], 9), d))[:10]
        asked.append((rows[i][0].astype(np.int64), idf[of[doc == i]], round(scores[best[6]], 9) if i % 2 else -np.inf))
        want.append((best[: 7 if i % 2 else 10], scores))
    for (_, _, least), (best, scores), (found, got) in zip(asked, want, shard.tops(asked, 10), strict=True):
        # ties at the threshold reach it too
        assert set(best) <= set(found.tolist()) and (scores[found] > least - 1e-8).all()
        np.testing.assert_allclose(got, scores[found], atol=1e-8)
    assert sum(added) < 0.6 * n * len(asked)
