"""Near-duplicates in dense groups, where most candidates fail: no link may be lost, whatever a walk leaves out at first."""

import numpy as np
from pyspark.sql import functions as F

from lintel.llm import simhash


def grown(random, copies, reached, own, more, n=200):
    """A text's near copies with `own` changed words each, and texts that are near only one of those, by `more` further changes."""
    base = [f"b{k}" for k in range(n)]

    def changed(words, tag, count):
        out = list(words)
        for k in random.choice(n // 6, count, replace=False) * 6 + int(random.integers(0, 6)):
            out[min(k, n - 1)] = f"{tag}x{k}"
        return out

    near = [changed(base, f"c{i}", own) for i in range(copies)]
    return near + [changed(near[int(random.integers(0, copies))], f"d{i}", more) for i in range(reached)]


def components(texts, similarity=0.8):
    sets = [{" ".join(w[k : k + 5]) for k in range(len(w) - 4)} for w in texts]
    number = {}
    flat = [np.array(sorted(number.setdefault(x, len(number)) for x in s)) for s in sets]
    held = np.zeros((len(texts), len(number)), dtype=np.float32)
    for row, ids in zip(held, flat, strict=True):
        row[ids] = 1
    common = held @ held.T
    size = held.sum(axis=1)
    links = common >= similarity * (size[:, None] + size[None, :] - common) - 1e-6
    root = np.arange(len(texts))
    while True:
        up = np.array([root[row].min() for row in links])
        if (up == root).all():
            return root, links
        root = up


def test_links_through_one_neighbour_are_found(spark):
    random = np.random.default_rng(12)
    texts = grown(random, 120, 250, 2, 4) + grown(random, 40, 60, 2, 4, n=204)
    order = random.permutation(len(texts))
    texts = [texts[i] for i in order]
    root, links = components(texts)
    assert len(set(root.tolist())) < 10 and (links.sum(axis=1) == 2).sum() > 100  # one group each, and many texts with one neighbour
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert got == dict(enumerate(root.tolist()))


def test_walk_names_whatever_it_leaves_out():
    random = np.random.default_rng(3)
    centre = random.integers(0, 2**32, 4).astype(np.uint64)
    values = np.sort(np.unique(np.concatenate([c ^ (np.uint64(1) << random.integers(0, 32, 80).astype(np.uint64)) ^ (np.uint64(1) << random.integers(0, 32, 80).astype(np.uint64)) for c in centre])))
    wide = values[:, None]
    near = np.bitwise_count(values[:, None] ^ values[None, :])
    want = {(a, b) for a, b in zip(*np.nonzero(near <= 4), strict=True) if a < b}
    for fan in (1, 3, 10**6):
        for held in (None, np.array([int(np.flatnonzero(near[i] <= 2)[0]) for i in range(len(values))])):
            held = held if held is None else held[held]  # some places joined with earlier ones
            pairs = []
            left_out = simhash.walk(values, [(0, len(values), 0, len(values), 0)], 0, 32, 4, wide, 4, fan, pairs, held)
            got = {(int(a), int(b)) for x in pairs for a, b in zip(*x[:2], strict=True)}
            assert got <= want and len(got) == sum(len(x[0]) for x in pairs)
            for a, b in want - got:
                assert (left_out[a] and left_out[b]) or (held is not None and held[a] == held[b])
            assert fan < 10**6 or not left_out.any()
            assert fan > 1 or len(got) < len(want) / 3


def test_sketches_rule_out_no_link():
    import pyarrow as pa

    random = np.random.default_rng(5)
    sets = []
    for n in (1, 7, 190, 190, 900, 5000, 70_000):
        base = random.integers(0, 2**63, n).astype(np.uint64)
        sets += [base, *[np.unique(np.concatenate([base[random.random(n) < keep], random.integers(0, 2**63, int(n * (1 - keep))).astype(np.uint64)])) for keep in (0.99, 0.9, 0.89, 0.88, 0.8, 0.3)]]
    sets.append(np.zeros(0, dtype=np.uint64))
    possible = simhash._possible(pa.array([simhash._sketch(np.unique(x)) if len(x) else bytes(simhash.BUCKETS) for x in sets], pa.binary()), 0.8)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    said = possible(a, b)
    ruled_out = 0
    for i, j, x in zip(a, b, said, strict=True):
        common = len(np.intersect1d(sets[i], sets[j]))
        links = common >= 0.8 * (len(np.union1d(sets[i], sets[j])))
        assert x or not links
        ruled_out += not x and 100 < len(sets[i]) < 1000 and 100 < len(sets[j]) < 1000
    assert ruled_out > 50


def test_tries_of_every_part_find_all_links(spark, monkeypatch):
    random = np.random.default_rng(9)
    values = np.unique(np.concatenate([random.integers(0, 2**63, 150), *[random.integers(0, 2**63, 1) ^ (np.int64(1) << random.integers(0, 62, 40)) for _ in range(5)]]))
    frame = spark.createDataFrame([(int(v), [int(v)]) for v in values], "id long, fp array<long>")
    near = np.bitwise_count(values[:, None].view(np.uint64) ^ values[None, :].view(np.uint64)) <= 3
    root = values.copy()
    while True:
        up = np.array([root[row].min() for row in near])
        if (up == root).all():
            break
        root = up
    for rows, block in ((2_000_000, 1 << 13), (2_000_000, 4), (1e-3, 4)):  # whole parts, many blocks, blocks below the parts
        monkeypatch.setattr(simhash, "TASK_ROWS", rows)
        monkeypatch.setattr(simhash, "BLOCK_ROWS", block)
        if rows < 1:
            monkeypatch.setattr(simhash, "min", lambda *x: min(*x, 3) if x[-1] == 20 else min(*x), raising=False)
        got = {r["node"]: r["root"] for r in simhash.components(simhash.trie_links(frame, 64, 1, 3)).collect()}
        assert got == {int(v): int(r) for v, r in zip(values, root, strict=True) if v != r}
    cuts = simhash.parts(32, 4)
    assert [x for x, _ in cuts] == [0, 7, 14, 20, 26] and simhash.earlier_parts(32, 4, 1) == (0b1111111,) and simhash.earlier_parts(32, 4, 2) == (0b1111111 << 7, 0b1111111)
    assert F is not None
