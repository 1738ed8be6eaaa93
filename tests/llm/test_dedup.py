"""Exact, near and passage dedup against brute force, on odd rows and hot groups."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusweave.llm import naming, passages, simhash

DOCS = "doc_id long, text string"


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def exact(rows):
    keyed = [(i, ascii_lower(t)) for i, t in rows]
    best, size, seen, out = {}, Counter(t for _, t in keyed), set(), []
    for i, t in keyed:
        best[t] = i if best.get(t) is None else max(best[t], -1 if i is None else i)
    for i, t in keyed:
        out.append((i, best[t], size[t], i == best[t] and (i, t) not in seen, hashlib.sha256(t.encode()).hexdigest()))
        seen.add((i, t))
    return out


def order(rows):
    return sorted(rows, key=repr)


def pairs_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


@pytest.mark.parametrize("block, longest", [(3, 40), (4096, 1_000_000)])
def test_exact_groups_on_odd_rows(spark, odd, block, longest):
    docs = odd.filter(F.coalesce(F.length("text"), F.lit(0)) <= longest)
    got = naming.exact_groups(docs, block_bytes=block)
    assert order(tuple(r)[:5] for r in got.collect()) == order(exact(pairs_of(docs)))


def test_exact_groups_when_digests_collide(spark):
    rnd = random.Random(1)
    rows = [(i, "".join(rnd.choice("abAB") for _ in range(rnd.randrange(9)))) for i in range(200)]
    got = naming.exact_groups(spark.createDataFrame(rows, DOCS), block_bytes=2, digest=lambda b: F.pmod(F.xxhash64(b), F.lit(3)))
    assert order(tuple(r)[:5] for r in got.collect()) == order(exact(rows))


def test_most_texts_are_named_in_pairs_and_names_hang_on_the_texts_alone(spark):
    rnd = random.Random(7)
    rows = [(i, "".join(rnd.choice("abcd ") for _ in range(rnd.choice((300, 2000, 5000))))) for i in range(60)] + [(100, "x" * 3000), (101, "x" * 3000), (102, "x" * 2999 + "y")]
    docs = spark.createDataFrame(rows, DOCS)
    names = [{r["doc_id"]: (r["n_blocks"], r["name"]) for r in naming.identities(d).collect()} for d in (docs, docs.repartition(7), docs.orderBy(F.desc("doc_id")).coalesce(1))]
    assert names[0] == names[1] == names[2]
    assert names[0][100] == names[0][101] != names[0][102]
    assert sum(n > 1 for n, _ in names[0].values()) > 30


def test_empty_tables(none):
    assert naming.exact_groups(none).count() == naming.keep_first(none).count() == 0
    assert simhash.components(none).count() == simhash.keep_one(none).count() == 0
    assert passages.dedup_passages(none).count() == 0


def test_keep_first_keeps_whole_rows(odd):
    kept = naming.keep_first(odd)
    assert kept.columns == odd.columns
    rows = [(i, ascii_lower(t)) for i, t in pairs_of(kept)]
    assert len(rows) == len({t for _, t in rows}) == len({ascii_lower(t) for _, t in pairs_of(odd)})


def fp(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))
    if not w:
        return 0
    runs = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    for t in ("", "  ", "one", "One two", "A b\tc\x0bd é", "x y z w", "a b c a b c a b c"):
        assert simhash.fingerprint(t) == fp(t)


def closure(fps, radius=3):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("block", [3, 2048])
def test_links_join_what_brute_force_joins(spark, block):
    rnd = random.Random(4)
    fps = {rnd.getrandbits(64) for _ in range(150)} | {0, (1 << 64) - 1}
    hot = rnd.getrandbits(64)
    for _ in range(120):  # a cluster in which nearly all share keys
        fps.add(hot ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(7))))
    fps = list(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = [tuple(r) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), block).collect()]
    at = {x: i for i, x in enumerate(signed)}
    assert all((fps[at[a]] ^ fps[at[b]]).bit_count() <= 3 for a, b in links)
    parent = {x: x for x in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    want = closure(fps)
    assert all((find(signed[i]) == find(signed[j])) == (want[i] == want[j]) for i in range(len(fps)) for j in range(i))


def test_every_pair_within_three_bits_shares_keys(spark):
    rnd = random.Random(9)
    rows = []
    for k in range(300):
        x = rnd.getrandbits(64)
        y = x ^ sum(1 << b for b in rnd.sample(range(64), 3))
        rows += [(k, v - (1 << 64) if v >> 63 else v) for v in (x, y)]
    first = spark.createDataFrame(rows, "pair long, fp long").select("pair", "fp", F.explode(simhash._keys()).alias("key"))
    second = first.select("pair", "fp", F.explode(simhash._second_keys()).alias("key"))
    for keyed in (first, second):
        assert keyed.groupBy("pair", "key").count().filter("count > 1").select("pair").distinct().count() == 300


def test_the_pivot_table_discards_the_pairs_of_a_cell():
    rnd = np.random.default_rng(12)
    x = rnd.integers(0, 1 << 63, 400, dtype=np.uint64) & np.uint64(0xFFFFFFFFFFFF)  # one group of 16 bits in common
    x[200:] = x[:200] ^ (np.uint64(1) << rnd.integers(0, 48, 200).astype(np.uint64))
    a, b = np.triu_indices(400, 1)
    left = simhash.survivors(x, a, b)
    alike = np.bitwise_count(x[a] ^ x[b]) <= 3
    assert set(np.flatnonzero(alike)) <= set(left.tolist()) and alike.sum() >= 200
    discarded = len(a) - len(left)
    assert discarded > 0.999 * (len(a) - alike.sum())  # by a coordinate difference alone
    cells = np.repeat(np.arange(25), 16)[:, None].repeat(3, 1)
    mixed = rnd.permutation(x)
    small = {tuple(sorted(p)) for p in simhash.cell_links(cells, mixed).tolist()}
    want = {tuple(sorted((int(mixed[i]), int(mixed[j])))) for c in range(25) for i in range(16 * c, 16 * c + 16) for j in range(16 * c, i) if int(mixed[i] ^ mixed[j]).bit_count() <= 3}
    assert small == want


def test_components_on_odd_rows(odd):
    got = simhash.components(odd).collect()
    rows = pairs_of(odd)
    assert sorted(repr((r["doc_id"], r["fp"] % (1 << 64))) for r in got) == sorted(repr((i, fp(t))) for i, t in rows)
    roots = closure([fp(t) for _, t in rows])
    smallest = {r: min((i for (i, _), q in zip(rows, roots) if q == r and i is not None), default=None) for r in roots}
    assert sorted(repr((r["doc_id"], r["component_id"])) for r in got) == sorted(repr((i, smallest[r])) for (i, _), r in zip(rows, roots))
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len(set(roots))


def removed(rows, size):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    often = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for (i, _), w in zip(rows, words):
        gone = {j for s in range(len(w) - size + 1) if often[tuple(w[s : s + size])] > 1 for j in range(s, s + size)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def spliced(rnd, n, passages_, words):
    rows = []
    for i in range(n):
        parts = [[rnd.choice(words) for _ in range(rnd.randrange(60))]]
        for _ in range(rnd.randrange(3)):
            p = list(rnd.choice(passages_))
            if rnd.random() < 0.3:
                p[rnd.randrange(len(p))] = "changed"
            parts += [p[rnd.randrange(10) :], [rnd.choice(words) for _ in range(rnd.randrange(20))]]
        rows.append((i, " ".join(w for p in parts for w in p)))
    return rows


@pytest.mark.parametrize("shard_segments", [2, 4096])
def test_passages_match_brute_force(spark, shard_segments):
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    rows = spliced(rnd, 60, [[rnd.choice(words) for _ in range(rnd.randrange(30, 90))] for _ in range(6)], words)
    rows += [(100, "x " * 200), (101, None), (102, rows[0][1]), (102, rows[0][1]), (None, rows[1][1])]
    got = passages.dedup_passages(spark.createDataFrame(rows, DOCS), shard_segments=shard_segments)
    assert order(tuple(r)[:4] for r in got.collect()) == order(removed(rows, 35))


def test_passages_on_odd_rows(odd):
    rows = [(i, t) for i, t in pairs_of(odd)]
    got = passages.dedup_passages(odd, window=6, gram=3)
    assert order(tuple(r)[:4] for r in got.collect()) == order(removed(rows, 6))


def test_fm_index_counts_windows():
    rnd = np.random.default_rng(3)
    for window in (4, 7, 10, 35):
        base = rnd.integers(1, 6, 300)
        texts = [base[s : s + window + rnd.integers(0, 20)].copy() for s in rnd.integers(0, 200, 12)]
        often = Counter(tuple(t[i : i + window]) for t in texts for i in range(len(t) - window + 1))
        index = passages.FMIndex(texts, window)
        places = [(k, i) for k, t in enumerate(texts) for i in range(len(t) - window + 1)]
        hits = index.repeated(np.array([index.starts[k] + i for k, i in places]))
        assert hits.tolist() == [often[tuple(texts[k][i : i + window])] > 1 for k, i in places]
        weights = rnd.integers(1, 3, len(texts)).tolist()
        heavy = Counter()
        for t, n in zip(texts, weights):
            heavy.update({w: n * c for w, c in Counter(tuple(t[i : i + window]) for i in range(len(t) - window + 1)).items()})
        index = passages.FMIndex(texts, window, weights)
        at = np.array([index.starts[k] + i for k, i in places])
        assert index.repeated(at).tolist() == [heavy[tuple(texts[k][i : i + window])] > 1 for k, i in places]
        # the statistic: the longest end of the window, in strides, that stands twice
        for (k, i), got in zip(places, index.matched(at).tolist()):
            end, best = i + window, 0
            for size in range(index.stride, window + 1, index.stride):
                run = texts[k][end - size : end].tolist()
                if sum(n * sum(t[j : j + size].tolist() == run for j in range(len(t) - size + 1)) for t, n in zip(texts, weights)) < 2:
                    break
                best = size
            assert got == best


def test_windows_of_one_anchor_are_one_segment():
    keys, starts, counts, places = passages.segments(b"x " * 100)
    assert len(keys) <= 2 and counts.sum() == 66 and places.sum() == 66
    rnd = random.Random(2)
    words = [str(rnd.randrange(50)).encode() for _ in range(500)]
    by_window = {}
    keys, starts, counts, _ = passages.segments(b" ".join(words + words[100:300]))
    for k, s, n in zip(keys, starts, counts):
        for w in range(s, s + n):
            by_window.setdefault(tuple((words + words[100:300])[w : w + 35]), set()).add(int(k))
    assert all(len(k) == 1 for k in by_window.values())


def test_wavelet_ranks():
    rnd = np.random.default_rng(8)
    for symbols, n in ((1, 5), (2, 64), (7, 200), (300, 1000)):
        seq = np.unique(rnd.integers(0, symbols, n), return_inverse=True)[1]  # every symbol occurs
        symbols = int(seq.max()) + 1
        tree = passages.WaveletTree(seq, symbols)
        c, at = rnd.integers(0, symbols, 500), rnd.integers(0, n + 1, 500)
        assert tree.rank(c, at).tolist() == [int((seq[:a] == s).sum()) for s, a in zip(c, at)]
