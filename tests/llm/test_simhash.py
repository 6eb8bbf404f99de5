import random
import re

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.llm import simhash as S


def brute(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + width]).encode(), 42) for i in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(items, radius=4):
    parent = {x: x for x in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(items):
        for y in items[:i]:
            if (x ^ y).bit_count() <= radius:
                a, b = sorted((find(x), find(y)))
                parent[b] = a
    return {x: find(x) for x in items}


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB \n\té\x0b.Z"), max_size=80))
def test_fingerprint(text):
    assert S.fingerprint(text) == brute(text)


def test_fingerprint_of_long_text():
    text = " ".join(f"W{i * i % 1013}" for i in range(3000))
    assert S.fingerprint(text) == brute(text)


def planted(seed, centres=12, each=25, most=9):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(centres)]
    near = {b ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(most))}) for b in base for _ in range(each)}
    return [0, *sorted(near)]


@pytest.mark.parametrize("seed", range(5))
def test_shard_links(seed):
    items = planted(seed)
    got = dict(S.shard_links(items, 4))
    assert {x: got.get(x, x) for x in items} == brute_components(items)


@pytest.mark.parametrize(("shard", "radius"), [(2048, 4), (20, 4), (20, 8)])
def test_components_by_bands(spark, shard, radius):
    """Crowded shards, dealt again down to any size, lose no link."""
    items = planted(7)
    signed = [x - (1 << 64) if x >> 63 else x for x in items]
    distinct = spark.createDataFrame([(x,) for x in signed], "fp long")
    labels = {r["fp"]: r["label"] for r in S.components(S.links(distinct, radius, shard)).collect()}
    want = brute_components(items, radius)
    groups = {}
    for x, s in zip(items, signed):
        groups.setdefault(labels.get(s, s), set()).add(x)
    whole = {}
    for x in items:
        whole.setdefault(want[x], set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, whole.values()))


def test_near_duplicates(spark, docs):
    got = S.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    fps = {r["doc_id"]: S.fingerprint(r["text"]) for r in docs.collect()}
    comps = brute_components(sorted(set(fps.values())))
    for r in got:
        mates = [d for d, f in fps.items() if comps[f] == comps[fps[r["doc_id"]]] and d is not None]
        assert r["component_id"] == min(mates, default=None)


def test_keep_one(spark, docs, no_docs):
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(1) == 1 and len(ids) == len(set(ids)) and 7 in ids
    assert 4 in ids and 5 not in ids and 6 not in ids  # wordless texts are one group
    assert S.keep_one(no_docs).count() == 0 and S.near_duplicates(no_docs).count() == 0


def test_components_of_long_chains(spark, monkeypatch):
    rng = random.Random(5)
    chains = [rng.sample(range(k << 20, (k + 1) << 20), 400) for k in range(4)]
    chains.append(list(range(9 << 20, (9 << 20) + 400)))
    links = [(max(a, b), min(a, b)) for c in chains for a, b in zip(c, c[1:])]
    rounds = []
    write = S.materialize
    monkeypatch.setattr(S, "materialize", lambda df, name: (rounds.append(name), write(df, name))[1])
    got = {r["fp"]: r["label"] for r in S.components(spark.createDataFrame(links, "fp long, root long")).collect()}
    assert got == {x: min(c) for c in chains for x in c}
    assert rounds.count("least-labels") <= 15


def jaccard(a, b, width=5):
    a, b = ({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set() for w in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rng, words, share):
    return [f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


def kept_by_brute_force(texts):
    """Ids of the first text of each component of links of similarity 0.8 or more."""
    parent = list(range(len(texts)))
    for i, t in enumerate(texts):
        for j in range(i):
            if jaccard(t, texts[j]) >= 0.8:
                a, b = sorted((find(parent, i), find(parent, j)))
                parent[b] = a
    return {i for i in range(len(texts)) if find(parent, i) == i}


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


@pytest.mark.parametrize("chunk", [4096, 3])
def test_keep_one_deletes_only_what_is_similar(spark, monkeypatch, chunk):
    monkeypatch.setattr(S, "CHUNK", chunk)
    rng = random.Random(9)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 400))]
        texts += [" ".join(base), *(" ".join(edited(rng, base, e)) for e in (0.004, 0.01, 0.05, 0.2))]
    df = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)], "doc_id long, text string, head string")
    got = {r["doc_id"] for r in S.keep_one(df).collect()}
    want = kept_by_brute_force(texts)
    assert want <= got and len(got - want) <= 0.1 * (len(texts) - len(want))


def test_keep_one_rows(spark):
    same = " ".join(f"w{i}" for i in range(80))
    rows = [(3, same), (3, same), (3, "other text of five words or more"), (None, same), (None, same), (5, None), (6, ""), (6, ""), (None, "alone with a null id here"), (8, same.upper() + "\n")]
    got = [tuple(r) for r in S.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(3, same), (3, rows[2][1]), (5, None), (None, rows[8][1])], key=str)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abC \n\té"), max_size=30), min_size=1, max_size=5), st.integers(2, 5))
def test_sets_equal_iff_shingles_do(texts, width):
    import pyarrow as pa

    got = [x.tobytes() for x in S.shingle_hashes(*S.word_hashes(pa.array(["skipped", *texts])[1:]), width)]
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t in texts]
    plain = [frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset() for w in words]
    assert [len(x) // 8 for x in got] == list(map(len, plain))
    assert all((a == b) == (p == q) for a, p in zip(got, plain) for b, q in zip(got, plain))


@pytest.mark.parametrize("seed", range(3))
def test_shard_candidates(seed, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 40)
    rng = random.Random(seed)
    base = [rng.getrandbits(128) for _ in range(6)]
    items = [b ^ sum({1 << rng.randrange(128) for _ in range(rng.randrange(12))}) for b in base for _ in range(30)]
    rng.shuffle(items)
    pairs, leading = S.shard_candidates(items)
    assert all((items[a] ^ items[b]).bit_count() <= S.WIDE_RADIUS for a, b in pairs)
    own = items[:40]
    for i, x in enumerate(own):  # a text's nearest in its tree is among the pairs
        near = min(((x ^ y).bit_count(), j) for j, y in enumerate(own) if j != i)
        if near[0] <= S.WIDE_RADIUS:
            assert any((x ^ items[b]).bit_count() == near[0] for a, b in pairs if a == i and b < 40)
    assert 6 <= len(leading) <= 12
    for i, x in enumerate(items):
        assert i in leading or any((x ^ items[k]).bit_count() <= S.WIDE_RADIUS for k in leading if k < i)


@pytest.mark.parametrize("listed", [200_000, 0])
def test_keep_one_loses_no_link(spark, monkeypatch, listed):
    """Groups whose texts are near many others that are not similar, or share 0.8 of their shingles with far fingerprints."""
    monkeypatch.setattr(S, "MOST", listed)
    rng = random.Random(4)
    frame = [f"f{k}" for k in range(400)]
    texts = []
    for _ in range(8):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(12, 90))]
        texts += [" ".join(edited(rng, base, 0.02)) for _ in range(12)]
        texts += [" ".join(frame[:300] + base + frame[300:])] * 2  # alike but for some words, similar or not
    for n in range(1, 9):
        texts += [" ".join(frame[:n]), " ".join(frame[: n + 1]), " ".join(["a"] * n)]
    rng.shuffle(texts)
    got = [r["doc_id"] for r in S.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()]
    assert sorted(got) == sorted(kept_by_brute_force(texts))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(0, 40), min_size=1, max_size=30), st.integers(0, 3)), max_size=30), st.sets(st.integers(0, 40)), st.booleans())
def test_shingle_pairs(sets, common, many):
    import numpy as np

    sets = sets * 4 if many else sets  # shingles that many have
    rows = [(s, i, label, len(x), p) for i, (x, label) in enumerate(sets) for p, s in enumerate(S.prefix(np.array(sorted(x), np.uint64), np.array(sorted(common), np.uint64), 0.8).tolist())]
    columns = [np.array(c, np.int64) for c in zip(*sorted(rows, key=lambda r: (r[0], r[2])))] if rows else [np.empty(0, np.int64)] * 5
    got = {(a, b) for pair in S.shingle_pairs(*columns, 0.8) for a, b in zip(*(x.tolist() for x in pair))}
    for i, (x, k) in enumerate(sets):
        for j, (y, m) in enumerate(sets[:i]):
            if k != m and len(x & y) >= 0.8 * len(x | y):
                assert (i, j) in got
    assert all(a > b and sets[a][1] != sets[b][1] for a, b in got)


@settings(max_examples=80, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=200), st.sets(st.integers(0, 2**64 - 1), max_size=200), st.sets(st.integers(0, 2**64 - 1), max_size=40))
def test_sets_that_are_similar_may_be(both, one, other):
    import numpy as np

    x, y = both | one, both | other
    marks = [v for s in (x, y) for v in (len(s), S.odd_bits(np.array(sorted(s), np.uint64)))]
    for least in (0.5, 0.8, 1.0):
        if len(x & y) >= least * len(x | y):
            assert S.sets_may_be_similar(*marks, least)


def test_few_unlike_sets_meet_whole(spark, monkeypatch):
    """Texts that share a rare passage and little else are pairs to look at, but their whole sets are not sent to one another."""
    monkeypatch.setattr(S, "MOST", 0)  # the passage is not known as common
    rng = random.Random(3)
    passage = [f"p{k}" for k in range(40)]
    texts = [" ".join([*(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(100, 160))), *passage]) for _ in range(60)]
    texts.append(" ".join([*texts[0].split()[:-1], "changed"]))
    sent, possible = [], S.possible_pairs

    def counted(*args):
        out = possible(*args)
        sent.append((args[1].count(), out.count()))
        return out

    monkeypatch.setattr(S, "possible_pairs", counted)
    got = sorted(r["doc_id"] for r in S.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert got == list(range(60)) == sorted(kept_by_brute_force(texts))
    assert sum(a for a, _ in sent) > 100 and sum(b for _, b in sent) < 5


def test_dealt_shingles_take_few_bytes(spark, monkeypatch):
    """What is dealt for a text that is alone grows with its shingles, not with the number of buckets that they are in."""
    monkeypatch.setattr(S, "BUCKET", 5)
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(400)) for _ in range(600)]
    rows = S.materialize(S.text_sets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 5, 0.8), "test-sets")
    nodes = rows.select("node", F.lit(1).alias("n"), "number")
    seen = []
    plain = type(rows).repartition
    monkeypatch.setattr(type(rows), "repartition", lambda self, *a: (seen.append(self), plain(self, *a))[1])
    assert S.remaining_pairs(rows, nodes, spark.createDataFrame([], "fp long, label long"), 0.8).count() == 0
    dealt = seen[0]
    each = sum(F.coalesce(F.octet_length(c), F.lit(0)) for c in dealt.columns if c not in ("bucket", "upper"))
    shingles = rows.agg(F.sum(F.octet_length("first_shingles"))).first()[0] / 8
    assert dealt.agg(F.sum(each)).first()[0] <= 10 * shingles
