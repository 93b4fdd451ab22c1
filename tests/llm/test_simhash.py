import random
from collections import defaultdict

import xxhash

from docketmill.llm import components, simhash


def brute(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", lower) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(items, near):
    parent = {x: x for x in items}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in items:
        for b in items:
            if near(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in items}


def test_near_duplicates_against_brute_force(docs, awkward):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(awkward)
    fps = {r[1]: brute(r[1]) for r in awkward}
    near = roots(sorted(set(fps.values())), lambda a, b: (a ^ b).bit_count() <= 2)
    least = defaultdict(list)
    for key, text, *_ in awkward:
        if key is not None:
            least[near[fps[text]]].append(key)
    want = sorted((r[0] or -1, f"{fps[r[1]]:016x}", min(least[near[fps[r[1]]]], default=-1)) for r in awkward)
    assert sorted((r.doc_id or -1, r.fingerprint, -1 if r.component_id is None else r.component_id) for r in got) == want


def test_planted_fingerprints_reach_each_other_over_chains(spark):
    rnd = random.Random(3)
    fps = set()
    for _ in range(40):
        x = rnd.getrandbits(64)
        for _ in range(rnd.randrange(12)):
            fps.add(x)
            x ^= sum(1 << b for b in rnd.sample(range(64), rnd.choice([1, 2, 3])))
    for radius in (2, 4):
        signed = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
        got = {(r.node, r.root) for r in components.components(simhash.links(signed, radius)).collect()}
        want = roots(sorted(r.fp for r in signed.collect()), lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= radius)
        members = defaultdict(set)
        for node, root in want.items():
            members[root].add(node)
        assert got == {(node, root) for root, group in members.items() if len(group) > 1 for node in group}


def test_long_text_is_counted_in_pieces(monkeypatch, awkward):
    text = awkward[7][1]
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "SHINGLES_AT_ONCE", 997)
    assert simhash.fingerprint(text) == whole


def test_empty_table_and_clashing_columns(none, clashing, docs):
    assert simhash.near_duplicates(none).collect() == []
    rows = lambda d: sorted(map(str, simhash.near_duplicates(d).collect()))
    assert rows(clashing) == rows(docs)


def test_components_of_long_path_star_and_nothing(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7), (None, 3), (5, 4)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(50)}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []
