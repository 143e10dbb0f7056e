"""Text operators against DuckDB or brute force, and their edge cases."""

import math
import random
import textwrap
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from conftest import DATA, same
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trajspark.llm import jaccard_join, licences, lm_scoring, mixing, packing, quality, search, token_counts, token_files, toxicity
from trajspark.llm.common import documents, scratch_dir
from trajspark.llm.encoding import Encoder
from trajspark.llm.queries import ORACLES, QUERIES

BPE = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(BPE)
LONG = "alpha beta gamma delta " * 3000
#: Nulls, empty and blank texts, ties, repeated rows, a special string, odd characters, a very long text.
ODD = [
    (1, None, "s0"), (2, "", None), (3, " \t\n ", "s1"), (4, "one", "s1"), (5, "a b c d e f g h i j k l", "s1"), (5, "a b c d e f g h i j k l", "s1"),
    (6, "x <|endoftext|> y  z\x1c é日本😀's don't", "s2"), (7, LONG, "s2"), (None, "no id at all but some words in it", None), (8, "A B C D E F G H I J K L", "s1"),
]
SCHEMA = "doc_id long, text string, source string, n_words long, score double, size long, label string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 9, 9.0, 9, "x") for r in ODD], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{DATA}/documents.parquet")


def ids(text):
    return np.array(LIBRARY.encode(text or "", add_special_tokens=False).ids, "<u4")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    same(QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLES[name]).df())


def test_encoder_is_the_library():
    rnd, enc = random.Random(0), Encoder(BPE)
    parts = ["a", "b c", " ", "  ", "\n", "\t", "'s", "'", "é", "1", "2³", ".", "!!", "word,", "<|endoftext|>", "\x1c", " ", "日本", "%", "\r\n", "ß", "😀"]
    for i in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        assert enc.ids(text) == ids(text).tobytes(), repr(text)
    other = public_tokenizers.path("word_bpe_49k.json")
    assert Encoder(other).ids("Some Words") == np.array(Tokenizer.from_file(other).encode("Some Words", add_special_tokens=False).ids, "<u4").tobytes()
    assert len(Encoder(public_tokenizers.path("piece_bpe_32k.model")).ids("Some Words")) > 0


def test_token_counts_cache(spark, odd, empty):
    cache = scratch_dir(spark) + "/cache"
    first = token_counts.count_tokens(odd.where("doc_id < 5"), BPE, cache).collect()
    second = token_counts.count_tokens(odd, BPE, cache).collect()
    want = Counter((r[0], len((r[1] or "").encode()), len(ids(r[1])), len(ids(r[1])) > 512) for r in ODD)
    assert Counter(map(tuple, second)) == want and len(first) == 4
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("content").distinct().count() == len({r[1] or "" for r in ODD})
    assert token_counts.count_tokens(empty, BPE, scratch_dir(spark) + "/cache").count() == 0
    # what is stored is used, under this tokenizer version only
    assert token_counts.count_tokens(odd, public_tokenizers.path("piece_bpe_32k.model"), cache).count() == len(ODD)


def test_token_files(spark, odd, empty):
    folder = scratch_dir(spark)
    got = token_files.read_documents(token_files.write_token_files(odd, BPE, folder), folder).toPandas().sort_values("start")
    rows = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))
    each = [np.r_[ids(r[1]), 2].astype("<u4") for r in rows]
    assert got["n_tokens"].tolist() == [len(x) for x in each]
    assert got["start"].tolist() == np.r_[0, np.cumsum([len(x) for x in each])[:-1]].tolist()
    assert got["ids_crc32"].tolist() == [zlib.crc32(x.tobytes()) for x in each]
    assert token_files.read_documents(token_files.write_token_files(empty, BPE, scratch_dir(spark)), folder).count() == 0


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17, 31])
def test_bit_packing(tmp_path, bits):
    import pyarrow as pa

    rng = np.random.default_rng(bits)
    each = [rng.integers(0, 1 << bits, n).astype("<u4") for n in (0, 1, 99, 1000, 3)]
    path = str(tmp_path / "f")
    with pa.OSFile(path, "wb") as out:
        w = token_files.TokenFileWriter(out, bits, 64)
        for i, x in enumerate(each):
            w.add(i, x.tobytes())
        w.close()
    with pa.OSFile(path) as source:
        f, flat = token_files.TokenFile(source), np.concatenate(each)
        assert (f.read(0, f.n) == flat).all()
        for a, b in [(0, 1), (63, 65), (100, 700), (5, 5), (1100, 2000)]:
            assert (f.read(a, b) == flat[a:b]).all()
        assert [d[2] for d in f.documents()] == [len(x) for x in each]


def check_packing(rows, capacity, want):
    """rows: pieces; want: ids of each document row, as a multiset of CRCs of whole documents."""
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        assert (s["offset"].to_numpy() == np.r_[0, s["length"].cumsum()[:-1]]).all() and s["length"].sum() <= capacity
    assert rows["length"].sum() == sum(map(len, want))
    # pieces of a document: the first is what is over, each has the CRC of its ids
    pieces = Counter(zip(rows["piece"], rows["start"], rows["length"], rows["ids_crc32"], strict=True))
    for x in want:
        x = np.asarray(x, "<u4")
        edges = [0, *range(len(x) % capacity or min(len(x), capacity), len(x) + 1, capacity)]
        for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            pieces[i, a, b - a, zlib.crc32(x[a:b].tobytes())] -= 1
    assert not any(pieces.values())


def test_packing_all(spark, docs):
    """The whole contract on all documents, and little waste."""
    got = packing.pack_documents(documents(spark, DATA), BPE).toPandas()
    each = {r.doc_id: np.r_[ids(r.text), 2] for r in docs.itertuples()}
    check_packing(got, 1024, list(each.values()))
    for d, s in got.sort_values("piece").groupby("doc_id"):
        assert s["piece"].tolist() == list(range(len(s))) and s["length"].sum() == len(each[d])
    assert got["sequence_id"].nunique() <= 1.05 * got["length"].sum() / 1024 + 4


def test_packing(spark, odd, empty):
    got = packing.pack_documents(odd, BPE).toPandas()
    each = [np.r_[ids(r[1]), 2].astype("<u4") for r in ODD]
    check_packing(got, 1024, each)
    whole = np.r_[ids(LONG), 2].astype("<u4")
    pieces = got[got["doc_id"] == 7].sort_values("piece")
    assert (pieces["length"].iloc[1:] == 1024).all() and [zlib.crc32(whole[a : a + n].tobytes()) for a, n in zip(pieces["start"], pieces["length"], strict=True)] == pieces["ids_crc32"].tolist()
    assert packing.pack_documents(empty, BPE).count() == 0


def test_open_bins():
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    assert [bins.place(n) for n in (10, 5, 6, 9)] == [(2, 0), (3, 0), (4, 0), (5, 0)]
    assert bins.place(5)[0] == 3 and bins.open == 1  # 6 was the fullest when 9 came
    rng = np.random.default_rng(0)
    n = rng.integers(1, 1024, 5000)
    bins = packing.OpenBins(1024, 4096)
    for x in sorted(n.tolist(), reverse=True):
        bins.place(x)
    assert bins.bins <= 1.01 * n.sum() / 1024 + 1


def test_mixing(spark, odd, empty, docs):
    got = mixing.mix_sources(odd).toPandas()
    assert len(got) == len(ODD) and (got["taken"] <= 2 * got["size"]).all()
    assert mixing.mix_sources(empty).count() == 0
    # many shards and a hot source: each source still comes near its target
    d = spark.createDataFrame(docs.assign(source=["hot" if i % 3 == 0 else s for i, s in enumerate(docs["source"])]))
    few = mixing.mix_sources(d, shard_words=2000, block=16).toPandas()
    by = few.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), size=("source_size", "first"))
    assert abs(by["target"].sum() - 1.5 * by["size"].sum()) < 1e-6 * by["size"].sum()
    assert (abs(by["taken"] - by["target"]) <= 0.02 * by["target"] + 64).all()
    again = mixing.mix_sources(d.repartition(5), shard_words=2000, block=16).toPandas()
    key = ["doc_id", "taken"]
    assert few[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()


def test_sainte_lague(spark):
    rng = np.random.default_rng(3)
    for seats in (1, 7, 40, 333):
        votes = rng.integers(0, 1000, 9).tolist()
        got = mixing.sainte_lague(spark.createDataFrame([(i, float(v), seats) for i, v in enumerate(votes)], "no int, votes double, seats long"), "votes", "seats", "no").toPandas().set_index("no")["quota"]
        want = Counter()
        for _ in range(seats):
            want[max(range(9), key=lambda i: (votes[i] / (2 * want[i] + 1), -i))] += 1
        assert [got[i] for i in range(9)] == [want[i] for i in range(9)]


def test_quality(spark, odd, empty):
    got = quality.quality_rules(odd).toPandas()
    assert len(got) == len(ODD) and not (got["kept"] & got["base_failed"]).any()
    row = got[got["doc_id"] == 7].iloc[0]
    assert row["n_words"] == 12000 and row["n_repeat_words"] == 12000 and row["base_failed"]
    blank = got[got["doc_id"].isin([1, 2, 3])]
    assert (blank[["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]] == 0).all().all() and blank["base_failed"].all()
    assert quality.quality_rules(empty).count() == 0


def brute_components(rows, n, percent):
    sets = []
    for _, text in rows:
        w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        import re

        w = re.findall(r"[^\x20\x09-\x0D]+", w)
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_jaccard_near_copies(spark, n, percent):
    """A family of near copies around the threshold, chains, short texts and equal sets."""
    rnd = random.Random(percent)
    words = [f"w{i}" for i in range(400)]
    base = [rnd.choice(words) for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base) if i < 100 else [rnd.choice(words) for _ in range(rnd.choice([1, 2, 8, 15, 40]))]
        for _ in range(rnd.randint(0, 5) if i < 100 else 0):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        rows.append((i, " ".join(w)))
    for i in range(150, 200):  # chains: each differs a little from the one before
        w = rows[-1][1].split() if i % 25 else [rnd.choice(words) for _ in range(60)]
        w[rnd.randrange(len(w))] = rnd.choice(words)
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, ""), (202, "one two"), (203, "ONE  two"), (204, "one")]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n, percent).toPandas()
    assert sorted(map(tuple, got[["doc_id", "n_shingles", "component_id"]].values.tolist())) == brute_components(rows, n, percent)


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_jaccard_common_passage(spark, monkeypatch, n, percent):
    """Near copies among documents that share a long passage; large signatures are dealt to blocks."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    rnd = random.Random(n)
    words = [f"w{i}" for i in range(900)]
    passage = [rnd.choice(words) for _ in range(60)]
    rows = []
    for i in range(160):
        own = [rnd.choice(words) for _ in range(rnd.choice([10, 20, 60]))]
        w = passage + own if i % 4 else list(rows[-1][1].split() if i else passage)
        if i % 4 == 0:
            w[rnd.randrange(len(w))] = rnd.choice(words)
        rows.append((i, " ".join(w)))
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n, percent).toPandas()
    assert sorted(map(tuple, got[["doc_id", "n_shingles", "component_id"]].values.tolist())) == brute_components(rows, n, percent)


def test_jaccard_edges(spark, odd, empty):
    got = jaccard_join.jaccard_components(odd).toPandas()
    assert len(got) == len(ODD) and set(got[got["doc_id"] == 8]["component_id"]) == {5}
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_jaccard_without_ids(spark):
    """Rows without an id link like others, and join what they link; the component is an id or null."""
    words = [f"w{i}" for i in range(60)]
    a, b, c = " ".join(words), " ".join([*words[:-1], "x"]), " ".join(["y", *words[1:-1], "x"])
    alone = " ".join(f"v{i}" for i in range(30))
    rows = [(7, a), (None, b), (3, c), (None, alone), (None, alone), (None, None)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted([(7, 3), (None, 3), (3, 3), (None, None), (None, None), (None, None)], key=str)


def test_signatures_meet():
    """Sets within the threshold keep a common signature, whatever their sizes and however frequent
    signatures are."""
    rng = np.random.default_rng(5)

    def kept(items, percent, often):
        out = set()
        for sigs, spare in jaccard_join.signatures(items, percent):
            out |= set(sorted(sigs.tolist(), key=lambda s: (-often(s), s))[spare:])
        return out

    for percent in (80, 90):
        for size in (1, 5, 9, 10, 19, 50, 99, 100, 101, 500, 3000):
            for salt in range(20):
                a = np.unique(rng.integers(0, 2**64, size, np.uint64))
                most = (100 - percent) * 2 * size // (100 + percent)
                gone, new = (lambda t: (t // 2, t - t // 2))(int(rng.integers(0, most + 1)))
                b = np.unique(np.r_[a[gone:], rng.integers(0, 2**64, new, np.uint64)])
                if 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)) and gone + new:
                    for often in (lambda s: 1, lambda s: s * (2 * salt + 1) % 97):  # noqa: B023
                        assert kept(a, percent, often) & kept(b, percent, often)


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    got = {r.node: r.component for r in jaccard_join.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if any(a != b and x in (a, b) for a, b in edges)}


def test_toxicity(spark, odd, empty):
    """Held-out precision and recall, and a pair of words that only together are toxic."""
    path = "/root/testdata/sf0.1"  # the smaller tables have too few labels to learn rare insults from
    got = QUERIES["op8_toxicity"](spark, path).toPandas()
    held = got.merge(pd.read_parquet(f"{path}/labels.parquet"), on="doc_id").query("held_out")
    hits = held.query("predicted == 1")
    assert hits["toxic"].mean() > 0.95 and held.query("toxic == 1")["predicted"].mean() > 0.8
    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(2000):
        a, b = rng.integers(0, 2, 2)
        rows.append(np.array([1] * a + [2] * b + [int(x) for x in rng.choice(np.arange(3, 12), 3, False)]))
        y.append(float(a and not b or b and not a))
    model = toxicity.fit(rows, np.array(y))
    z, _ = toxicity._margin(model, np.searchsorted(model.places, np.concatenate(rows)), np.cumsum([len(r) for r in rows]))
    assert ((z > 0) == np.array(y)).mean() > 0.99  # no weights of single words can do that
    scored = toxicity.score_toxicity(odd, model).toPandas()
    assert sorted(scored.columns) == sorted(odd.columns) and toxicity.score_toxicity(odd, model, score_col="Label").toPandas()["score"].eq(9).all()
    assert len(scored) == len(ODD) and scored["score"].between(0, 1).all()
    assert toxicity.score_toxicity(empty.drop("score"), model).count() == 0
    assert len(toxicity.train_toxicity(empty, spark.createDataFrame([], "doc_id long, toxic int")).places) == 0


def brute_losses(rows, target, vocabulary):
    """Mean losses (background, target) of each text, with a text's own pairs left out."""
    each = [x.lower().split() if x else [] for _, x in rows]
    own = [i in target for i, _ in rows]
    single, pairs, begun = ([Counter(), Counter()] for _ in range(3))
    for w, t in zip(each, own, strict=True):
        single[t].update([None, *w] if w else [])
        pairs[t].update(zip([None, *w], w, strict=False))
        begun[t].update([None, *w][:-1])
    size = len({x for w in each for x in w})
    whole = single[0] + single[1]
    often = sorted((x for x in whole if x), key=lambda x: (-whole[x], x.encode()))[:vocabulary]
    out = []
    for w, t in zip(each, own, strict=True):
        mine, losses = Counter(zip([None, *w], w, strict=False)), []
        for row in (0, 1):
            total = sum(n for x, n in single[row].items() if x)
            mean = (total - sum(single[row][x] for x in often)) / max(size - len(often), 1)
            loss = 0.0
            for a, b in zip([None, *w], w, strict=False):
                less = mine[a, b] if row == t else 0
                alone = ((single[row][b] if b in often else mean) + lm_scoring.ADDED) / (total + lm_scoring.ADDED * size)
                loss -= math.log(lm_scoring.PAIR_WEIGHT * (pairs[row][a, b] - less) / max(begun[row][a] - less, 1) + (1 - lm_scoring.PAIR_WEIGHT) * alone)
            losses.append(loss / len(w) if w else None)
        out.append(losses)
    return out


@pytest.mark.parametrize(("vocabulary", "top"), [(300, 20), (100_000, 1024), (5, 1)])
def test_lm_scoring(spark, docs, vocabulary, top):
    """Against counts in dictionaries, however few words and pairs are frequent."""
    d = documents(spark, DATA).select("doc_id", "text")
    got = lm_scoring.score_corpus(d, d.where("doc_id % 3 = 0").select("doc_id"), vocabulary=vocabulary, top=top).toPandas().set_index("doc_id")
    rows = list(zip(docs["doc_id"].tolist(), docs["text"].tolist(), strict=True))
    assert len(got) == len(docs)
    for (i, x), (background, target) in zip(rows, brute_losses(rows, {i for i, _ in rows if i % 3 == 0}, vocabulary), strict=True):
        if background is None:
            assert np.isnan(got["score"][i])
        else:
            assert got["n_words"][i] == len(x.split()) and abs(got["ce_background"][i] - background) < 1e-9 and abs(got["ce_target"][i] - target) < 1e-9
            assert abs(got["score"][i] - (target - background)) < 1e-9


def test_distinct_rows():
    """Packed to one number, or as rows where that would not fit."""
    rnd = np.random.default_rng(0)
    small = [rnd.integers(0, 5, 200) for _ in range(3)]
    wide = [c * (1 << 24) + (1 << 40) for c in small]
    (one, k), (two, m) = lm_scoring._distinct(*small), lm_scoring._distinct(*wide)
    want = Counter(zip(*(c.tolist() for c in small), strict=True))
    assert Counter(dict(zip(zip(*(c.tolist() for c in one), strict=True), k.tolist(), strict=True))) == want
    assert [(c * (1 << 24) + (1 << 40)).tolist() for c in one] == [c.tolist() for c in two] and k.tolist() == m.tolist()


def test_lm_scoring_edges(spark, odd, empty):
    rows = lm_scoring.score_corpus(odd, odd.where("doc_id = 5")).toPandas()
    assert len(rows) == len(ODD) and rows["score"].isna().sum() == 3 and sorted(rows.columns) == sorted(["doc_id", "n_words", "ce_target", "ce_background", "score"])
    assert lm_scoring.score_corpus(empty, empty).count() == 0


def test_lm_scoring_tells_apart(spark):
    """Unseen texts like the target score lower than others; a text that occurs twice is likelier in the background."""
    rnd = random.Random(4)
    kinds = [[f"{k}{i}" for i in range(80)] + [f"both{i}" for i in range(40)] for k in "ab"]
    rows = [(i, " ".join(rnd.choice(kinds[i % 2]) for _ in range(60))) for i in range(200)]
    rows += [(i + 1000, rows[i][1]) for i in range(1, 41, 2)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = lm_scoring.score_corpus(d, d.where("doc_id < 100 and doc_id % 2 = 0")).toPandas().set_index("doc_id")
    assert got["score"][range(100, 200, 2)].max() < got["score"][range(41, 200, 2)].min()
    assert got["ce_background"][range(1, 41, 2)].max() < got["ce_background"][range(41, 200, 2)].min()


@pytest.mark.parametrize(("buckets", "most"), [(1, 1_000_000), (7, 1_000_000), (100_000, 500)])
def test_lm_pairs_travel_by_bucket(spark, docs, buckets, most):
    """A row a text and one a bucket of many texts' pairs, not one a pair; losses don't depend on buckets."""
    d = documents(spark, DATA).select(F.col("doc_id").alias("_id"), "text", (F.col("doc_id") % 3 == 0).alias("target")).coalesce(2)
    v = lm_scoring.learn_vocabulary(d, 300, 20)
    packed = "bucket long, first long, groups binary, keys binary, rows binary, ks binary, of_text struct<row: long, n: long, x: double, y: double, _id: long>"
    rows = d.mapInArrow(lm_scoring._texts_and_pairs(v, "_id", buckets, most), packed)
    dealt = rows.agg(F.count("of_text"), F.count("keys"), F.sum(F.octet_length("keys")) / 8).first()
    assert dealt[0] == len(docs) and dealt[2] > 20_000 and (most == 500 or dealt[1] <= 2 * buckets)
    sums = rows.groupBy("bucket").applyInArrow(lm_scoring._losses_of_pairs(v.context, v.chance, "_id"), "row long, n long, l0 double, l1 double, _id long").groupBy("row").agg(F.max("_id").alias("_id"), F.max("n").alias("n"), F.sum("l0").alias("l0"), F.sum("l1").alias("l1")).toPandas().set_index("_id")
    texts = list(zip(docs["doc_id"].tolist(), docs["text"].tolist(), strict=True))
    for (i, _), (background, target) in zip(texts, brute_losses(texts, {i for i, _ in texts if i % 3 == 0}, 300), strict=True):
        if background is not None:
            assert abs(sums["l0"][i] / sums["n"][i] - background) < 1e-9 and abs(sums["l1"][i] / sums["n"][i] - target) < 1e-9


def test_search_repeated_queries_and_ties(spark):
    """A query that stands twice is one query; among equal scores smaller ids win, also at the last rank."""
    rows = [(i, "tie one two") for i in range(30)] + [(40 + i, f"tie {i} other words") for i in range(30)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    twice = spark.createDataFrame([(9, "tie one"), (9, "tie one")], "doc_id long, text string")
    got = search.top_k(d, twice, 7).toPandas().sort_values("rank")
    once = search.top_k(d, twice.limit(1), 7).toPandas().sort_values("rank")
    assert got["doc_id"].tolist() == list(range(7)) and np.allclose(got["score"], once["score"])


def test_search_edges(spark, odd, empty):
    got = search.top_k(odd, odd.where("doc_id in (1, 5, 7)"), 3).toPandas()
    assert set(got["query_id"]) == {5, 7} and got.query("query_id == 5 and rank == 1")["doc_id"].iloc[0] == 5
    assert search.top_k(empty, odd, 3).count() == 0


def test_search_prunes_exactly():
    rng = np.random.default_rng(4)
    n, vocab = 700, 60
    rows = [np.unique(rng.zipf(1.5, 20).clip(max=vocab), return_counts=True) for _ in range(n)]
    lens = np.array([r[1].sum() for r in rows])
    shard = search.Shard(np.arange(n), lens, np.r_[0, np.cumsum([len(r[0]) for r in rows])], np.concatenate([r[0] for r in rows]).astype(np.int64), np.concatenate([r[1] for r in rows]), lens.mean())
    for _ in range(30):
        terms = np.unique(rng.integers(1, vocab + 5, 6))
        idf = rng.random(len(terms)) * 3
        want = np.zeros(n)
        for d, (t, c) in enumerate(rows):
            for w, tf in zip(t, c, strict=True):
                if w in terms:
                    want[d] += idf[list(terms).index(w)] * tf * (search.K1 + 1) / (tf + search.K1 * (1 - search.B + search.B * lens[d] / lens.mean()))
        best = sorted(np.flatnonzero(want > 0), key=lambda d: (-round(want[d], 9), d))[:10]
        found, scores = shard.top(terms, idf, 10)
        np.testing.assert_allclose(sorted(scores, reverse=True), want[best], atol=1e-9)


def test_search_scores_few_in_full():
    """Whole texts as queries: sums of lists bound scores so well that few documents are scored in full."""
    rng = np.random.default_rng(5)
    n = 3000
    rows = [np.unique(rng.zipf(1.3, size).clip(max=20_000), return_counts=True) for size in rng.integers(10, 400, n)]
    lens = np.array([r[1].sum() for r in rows])
    shard = search.Shard(np.arange(n), lens, np.r_[0, np.cumsum([len(r[0]) for r in rows])], np.concatenate([r[0] for r in rows]).astype(np.int64), np.concatenate([r[1] for r in rows]), lens.mean())
    df = np.bincount(np.concatenate([r[0] for r in rows]), minlength=20_001)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    asked = [rows[i][0].astype(np.int64) for i in range(0, n, 100)]
    alone = [shard.top(t, idf[t], 10) for t in asked]
    assert shard.scored <= 35 * len(asked)  # the first ones for a threshold, and the best
    for t, (found, scores), (same, again) in zip(asked, alone, shard.tops([(t, idf[t], -np.inf) for t in asked], 10), strict=True):
        own = set(t.tolist())
        want = np.array([sum(idf[w] * tf * (search.K1 + 1) / (tf + search.K1 * (1 - search.B + search.B * m / lens.mean())) for w, tf in zip(*r, strict=True) if w in own) for r, m in zip(rows, lens, strict=True)])
        best = sorted(range(n), key=lambda d: (-round(want[d], 9), d))[:10]
        assert sorted(found) == sorted(same) == sorted(best)
        np.testing.assert_allclose(sorted(scores, reverse=True), want[best], atol=1e-8)
        np.testing.assert_allclose(np.sort(again), np.sort(scores), atol=1e-9)


def test_licences(spark, odd, empty, docs):
    model = licences.train_licences(documents(spark, "/root/testdata/sf0.01").select("doc_id", "text"))
    lines = ["Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "Die Katze kommt mit dem Hund in die Stadt", "The new version of this work is under review."]
    table = spark.createDataFrame([(i, f"first line here\n{x}\nlast one") for i, x in enumerate(lines)], "doc_id long, text string")
    got = licences.licences_of_documents(table, model).toPandas().sort_values("doc_id")
    assert got["families"].tolist() == ["MIT", "GPL", "Apache", "CC-BY-NC", "", ""] and got["n_licences"].tolist() == [1, 1, 1, 1, 0, 0]
    assert licences.licences_of_documents(odd, model).count() == 8
    assert licences.licences_of_documents(empty, model).count() == 0


def test_wrapped_licences(spark):
    """Notices over several lines, as headers of sources have them, are one statement each."""
    model = licences.train_licences(documents(spark, "/root/testdata/sf0.01").select("doc_id", "text"))
    notices = {
        "GPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "Apache": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    }
    rows = [(f, w, "import this\n\n" + "\n".join(f" * {x}" for x in textwrap.wrap(n, w)) + "\n *\n\nthe cat sat on the mat\nand slept") for f, n in notices.items() for w in (20, 45, 72)]
    table = spark.createDataFrame([(i, r[2]) for i, r in enumerate(rows)] + [(99, "the cat sat on the mat\nand the new version\nof this work is free\nto the public")], "doc_id long, text string")
    got = licences.licences_of_documents(table, model).toPandas().set_index("doc_id")
    assert [(r[0], r[1], got["families"][i], got["n_licences"][i]) for i, r in enumerate(rows)] == [(*r[:2], r[0], 1) for r in rows]
    assert got["families"][99] == ""


def test_factorization_machine_is_explicit_pairs():
    """The margin is bias, single terms and all pairs of terms, written out."""
    rng = np.random.default_rng(3)
    model = toxicity.Model(np.arange(6), 0.3, rng.normal(size=6), rng.normal(size=(6, 4)))
    rows = [[0, 2, 5], [], [1], [0, 1, 2, 3, 4, 5]]
    got = toxicity._margin(model, np.array(sum(rows, []), np.int64), np.cumsum([len(r) for r in rows]))[0]
    want = [model.bias + sum(model.linear[i] for i in r) + sum(model.factors[i] @ model.factors[j] for i in r for j in r if i < j) for r in rows]
    assert np.allclose(got, want)


def test_columns_with_clashing_names(spark, docs):
    """Columns named like anything that operators and stages add come through untouched."""
    import corpus_pipeline as cp

    names = ["n_words", "_words", "_lines", "_row", "row", "row_key", "copies", "_copy", "score", "kept", "_id", "node", "component_id", "size", "key", "target"]
    table = documents(spark, DATA).limit(60)
    for i, c in enumerate(names):
        table = table.withColumn(c, F.col("doc_id") * 100 + i)
    nulls = spark.createDataFrame([(None,) * len(table.columns), (None, "", *(None,) * (len(table.columns) - 2))], table.schema)
    table = table.union(table.limit(2)).union(nulls)
    judged = quality.quality_rules(table).toPandas()
    assert {"_words", "_lines", "_row"} <= set(judged.columns) and (judged["_lines"].dropna() == judged["doc_id"].dropna() * 100 + 2).all()
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, table, DATA)
        rows = out.toPandas()
        assert out.columns == table.columns and len(rows)
        for i, c in enumerate(names):
            assert (rows[c].dropna() == rows["doc_id"].dropna() * 100 + i).all()
        assert stage(spark, table.limit(0), DATA).columns == table.columns
    assert cp.STAGES[-1][1](spark, table, DATA).count() >= 64


def test_pipeline(spark):
    """Every stage against its operator's plain meaning on the documents that came before."""
    import corpus_pipeline as cp

    docs = documents(spark, DATA)
    at = {}
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, DATA)
        at[name] = docs.toPandas()
        docs = spark.createDataFrame(at[name], docs.schema)
    first, toxic, near, mixed, packed = (at[n] for n, _ in cp.STAGES)
    assert list(first.columns) == list(toxic.columns) == list(near.columns) == list(mixed.columns)
    assert set(toxic["doc_id"]) <= set(first["doc_id"])
    want = brute_components(list(zip(toxic["doc_id"], toxic["text"], strict=True)), 5, 80)
    assert sorted(near["doc_id"]) == sorted({c for _, _, c in want})
    assert mixed.groupby("doc_id").size().max() <= 2 and set(mixed["doc_id"]) <= set(near["doc_id"])
    check_packing(packed, 1024, [np.r_[ids(x), 2] for x in mixed["text"]])
