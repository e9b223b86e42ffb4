import random
import re

import numpy as np
import xxhash

from chronolake.llm import simhash

from .conftest import words


def plain_print(text):
    own = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(own[i : i + 3]) for i in range(max(1, len(own) - 2))] if own else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute(prints, radius=3):
    """print -> the prints reachable from it."""
    prints, group = sorted(set(prints)), {}
    for p in prints:
        if p not in group:
            todo, seen = [p], {p}
            while todo:
                x = todo.pop()
                new = [q for q in prints if q not in seen and (x ^ q).bit_count() <= radius]
                seen.update(new), todo.extend(new)
            group |= dict.fromkeys(seen, frozenset(seen))
    return group


def check(docs, got, radius=3):
    own = [(i, plain_print(t)) for i, t in docs]
    groups = brute([p for _, p in own], radius)
    least = {}
    for i, p in own:
        if i is not None:
            least[groups[p]] = min(i, least.get(groups[p], i))
    want = sorted(((i, f"{p:016x}", least.get(groups[p])) for i, p in own), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got.collect()), key=str) == want


def test_documents(spark, edge_docs, no_docs):
    """Odd texts, and copies of a text with one word after the other changed."""
    got = simhash.near_duplicates(edge_docs)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    check([(r.doc_id, r.text) for r in edge_docs.collect()], got)
    assert simhash.near_duplicates(no_docs).count() == 0
    rnd = random.Random(8)
    rows = []
    for g in range(4):
        base = words(rnd, 400)
        for i in range(25):
            base[rnd.randrange(400)] = f"new{i}"
            rows.append((100 * g + 99 - i, " ".join(base)))
    rows += [(7, rows[3][1]), (rows[0][0], "another text of one id"), (None, rows[30][1]), (900, None), (901, " \n"), (902, "")]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(4)
    for radius, blocks in ((3, None), (3, 4), (3, 5), (3, 6), (0, None), (6, 8)):
        check(rows, simhash.near_duplicates(docs, radius, blocks), radius)


def test_planes_find_what_counting_bits_finds():
    rng = np.random.default_rng(2)
    for n in (1, 63, 64, 65, 300):
        base = rng.integers(0, 2**63, 3, np.uint64)[rng.integers(0, 3, n)]
        for _ in range(4):
            base ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
        planes, many = simhash.planes_of(base), -(-n // 64)
        members, blocks = np.repeat(np.arange(n), many), np.tile(np.arange(many), n)
        for radius in (0, 1, 3, 4, 7):
            got = set()
            for place, lane in simhash.near(base, planes, members, blocks, radius):
                got |= {(int(members[p]), 64 * int(blocks[p]) + int(x)) for p, x in zip(place, lane, strict=True)}
            want = {(i, j) for i in range(n) for j in range(n) if (int(base[i]) ^ int(base[j])).bit_count() <= radius}
            assert {p for p in got if p[1] < n} == want


def test_links_are_a_forest_of_the_same_components():
    rng = np.random.default_rng(4)
    groups = []
    for n in (2, 5, 200, 1000):
        own = np.full(n, rng.integers(0, 2**63, dtype=np.uint64))
        for _ in range(5):
            own ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
        groups.append(np.unique(own))
    a, b = simhash.links(groups, [None] * len(groups))
    assert len(a) < sum(map(len, groups))
    for own in groups:
        inside = [(int(x), int(y)) for x, y in zip(a, b, strict=True) if x in own]
        up = {int(x): int(x) for x in own}

        def root(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        for x, y in inside:
            up[root(y)] = root(x)
        want = brute(map(int, own))
        assert len({root(x) for x in up}) == len(set(want.values())) and all((root(x) == root(y)) == (want[x] is want[y] or want[x] == want[y]) for x in list(up)[:40] for y in up)


def test_large_buckets_are_compared_in_cells(spark, monkeypatch):
    """Cells of two chunks find the same components as one piece; tasks get the small chunk with the plan."""
    rng = np.random.default_rng(6)
    own = np.full(600, 0x0123456789ABCDEF, np.uint64)
    for _ in range(4):
        own ^= np.uint64(1) << rng.integers(0, 40, 600).astype(np.uint64)  # the upper bits are one bucket
    own = np.unique(own)
    prints = spark.createDataFrame([(int(x),) for x in own.view(np.int64)], "print long")
    monkeypatch.setattr(simhash, "CHUNK", 50)
    found = simhash.linked(prints).collect()
    names = {int(x): int(x) for x in own.view(np.int64)}

    def root(x):
        while names[x] != x:
            x = names[x]
        return x

    for a, b in found:
        names[root(b)] = root(a)
    want = brute(map(int, own))
    assert len({root(x) for x in names}) == len(set(want.values()))
    assert all((a ^ b).bit_count() <= 64 and want[a & (2**64 - 1)] == want[b & (2**64 - 1)] for a, b in found)
    assert len(found) < 4 * len(own) * (len(own) // 50 + 2)


def test_the_number_of_tables_follows_the_number_of_classes():
    assert simhash.blocks_for(1000) == 4 and simhash.blocks_for(10**9) > 4
    for blocks in range(4, 8):
        for cut in simhash.tables(3, blocks):
            assert len(cut) == blocks - 3
        assert sum(bits for _, bits in {x for cut in simhash.tables(3, blocks) for x in cut}) == 64
