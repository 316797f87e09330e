import heapq
import random
from collections import Counter
from fractions import Fraction
from math import ceil, floor

import pytest

from inkprint.llm.mixing import mixed, mixed_slots, one_period, phases, whole_shares


@pytest.mark.parametrize("seed", range(8))
def test_less_than_one_block_off(seed):
    draw = random.Random(seed)
    shares = whole_shares({f"s{i}": draw.random() ** 3 + 0.001 for i in range(draw.randint(1, 30))}, 500)
    assert sum(shares.values()) == 500
    places = one_period(shares)
    assert sorted(p for x in places.values() for p in x) == list(range(500))
    for s, a in shares.items():
        done = 0
        for t in range(500):
            done += t in set(places[s])
            assert abs(Fraction(a * (t + 1), 500) - done) < 1
        for j, p in enumerate(places[s]):
            assert floor(Fraction(j * 500, a)) <= p < ceil(Fraction((j + 1) * 500, a))


def simulated(shares, blocks):
    """Slot by slot: earliest deadline first among released blocks, anew when a source ends."""
    order, done, slot = {}, dict.fromkeys(blocks, 0), 0
    left = {s: a for s, a in shares.items() if blocks[s]}
    while left:
        period, begin, base = sum(left.values()), slot, dict(done)
        while all(done[s] < blocks[s] for s in left):
            ready = []
            for rank, (s, a) in enumerate(left.items()):
                j = done[s] - base[s]
                if j * period // a <= slot - begin:
                    heapq.heappush(ready, (-(-(j + 1) * period // a), rank, s))
            s = heapq.heappop(ready)[2]
            order[s, done[s]] = slot
            done[s] += 1
            slot += 1
        left = {s: a for s, a in left.items() if done[s] < blocks[s]}
    return order


def planned(shares, blocks):
    out = {}
    for s, parts in phases(shares, blocks).items():
        for p in parts:
            for j in range(p.count):
                out[s, p.first + j] = p.start + j // p.share * p.period + p.places[j % p.share]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_phases_against_simulation(seed):
    draw = random.Random(seed)
    names = [f"s{i}" for i in range(draw.randint(1, 6))]
    shares = whole_shares({s: draw.randint(1, 9) for s in names}, 20)
    blocks = {s: draw.randint(0, 90) for s in names}
    assert planned(shares, blocks) == simulated(shares, blocks)


def test_rows(corpus):
    draw = random.Random(1)
    rows = [(i, "x" * draw.randint(0, 300), "en", draw.choice(["a", "a", "a", "b", "c", None])) for i in range(400)]
    rows += [(500, "y" * 5000, "en", "c"), (501, None, "en", "b"), (None, "z", "en", "b"), (3, rows[3][1], "en", rows[3][3])]
    df = corpus(rows, "slot block draw j now")
    weights = {"a": 1.0, "b": 2.0, "c": 1.0, None: 1.0}
    found = mixed_slots(df, weights, block_bytes=1000, resolution=50).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in rows)
    blocks = {}
    for source in weights:
        own = sorted([r for r in found if r["source"] == source], key=lambda r: r["place"])
        assert [r["place"] for r in own] == [sum(x["size"] for x in own[:i]) for i in range(len(own))]
        assert all(r["block"] == r["place"] // 1000 for r in own)
        blocks[source] = -(-sum(r["size"] for r in own) // 1000)
    order = sorted(weights, key=lambda s: (s is None, s or ""))
    slots = simulated(whole_shares({s: weights[s] for s in order}, 50), {s: blocks[s] for s in order})
    assert all(r["slot"] == slots[r["source"], r["block"]] for r in found)
    assert all(r["release"] < r["deadline"] for r in found)


def test_layout(corpus, spark, tmp_path):
    rows = [(i, "x" * 200, "en", "a" if i % 3 else "b") for i in range(300)] + [(None, None, "en", None)]
    df = corpus(rows, "_slot _key")
    out = mixed(df, weights={"a": 1, "b": 1}, block_bytes=1000)
    assert out.columns == df.columns and out.count() == 301
    slot = {r["doc_id"]: (r["slot"], r["place"]) for r in mixed_slots(df, {"a": 1, "b": 1}, block_bytes=1000).collect()}
    got = [slot[r["doc_id"]] for r in out.collect()]
    assert got == sorted(got)


def test_empty_table(corpus):
    assert mixed_slots(corpus([])).collect() == []
    assert mixed(corpus([])).collect() == []
