"""Plans and packed items: nothing lost, nothing too full, little room left."""

import random
from collections import Counter

import pytest

from quartzfold.llm.packing import filling, pack, plan


def test_plan_places_every_count():
    draw = random.Random(3)
    for _ in range(200):
        capacity = draw.choice([1, 7, 64, 512])
        counts = Counter(draw.randint(1, draw.choice([capacity, max(1, capacity // 8)])) for _ in range(draw.choice([0, 1, 40, 3000])))
        slots, n = plan(counts, capacity)
        placed, held = Counter(), Counter()
        for s in slots:
            assert s.start == placed[s.length]
            placed[s.length] += s.per * s.repeat
            for c in range(s.first, s.first + s.repeat):
                held[c] += s.per * s.length
        assert placed == counts and all(v <= capacity for v in held.values()) and set(held) == set(range(n))
        total = sum(k * v for k, v in counts.items())
        # at most one container in two may be under half full
        assert n <= 2 * total / capacity + 1
    with pytest.raises(ValueError):
        plan({9: 1}, 8)


def test_packed_items(spark):
    draw = random.Random(4)
    sizes = [(i, draw.choice([0, None, 1, 1, 1, 5, 17, 17, 30, 31, 32, 33, 100, 3200])) for i in range(800)] + [(5, 7), (5, 7), (None, 3)]
    kinds = spark.createDataFrame([("s", 32), ("l", 500), ("bad", 0), ("none", None), (None, 8)], "container_kind string, capacity_tokens int")
    packed = pack(spark.createDataFrame(sizes, "doc_id long, n_tokens int").repartition(4), kinds, "doc_id")
    rows = packed.collect()
    for kind, capacity in (("s", 32), ("l", 500)):
        own = [r for r in rows if r["container_kind"] == kind]
        held = Counter()
        for r in own:
            held[r["container_id"]] += r["n_tokens"]
        assert max(held.values()) <= capacity
        assert sorted(Counter((r["doc_id"], r["n_tokens"]) for r in own if r["part_no"] == 0).elements(), key=str) == sorted(((i, min(n or 0, capacity)) for i, n in sizes), key=str)
        assert sum(r["n_tokens"] for r in own) == sum(n or 0 for _, n in sizes)
        assert all(r["n_tokens"] == capacity for r in own if any(o["doc_id"] == r["doc_id"] and o["part_no"] > r["part_no"] for o in own) and r["doc_id"] != 5)
    f = {r["container_kind"]: r for r in filling(packed, kinds).collect()}
    assert set(f) == {"s", "l"} and f["l"]["filled"] > 0.97
    assert pack(spark.createDataFrame([], "doc_id long, n_tokens int"), kinds, "doc_id").count() == 0
