import random
import zlib
from collections import Counter, defaultdict

from helixframe.llm import sharding as sh

from .util import AWKWARD, clashing, documents, empty, real_texts


def check(spark, rows, shards, **kw):
    got = sh.shard_by_size(clashing(documents(spark, rows)), shards, **kw).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    text = dict(rows)
    slots, where, load = defaultdict(list), defaultdict(set), Counter()
    for r in got:
        t = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(t) + 8, zlib.crc32(t))
        slots[r["shard"]].append(r["slot"])
        where[t].add(r["shard"])
        load[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in where.values())
    return load


def test_awkward_and_empty(spark):
    check(spark, AWKWARD, 4)
    assert sh.shard_by_size(empty(spark)).count() == 0


def test_near_equal_bytes(spark):
    load = check(spark, real_texts(1000), 24)
    sizes = sorted(load.values())
    assert len(sizes) == 24
    assert sizes[-1] < 1.02 * sum(sizes) / 24


def test_hot_group_keeps_together_and_the_rest_is_even(spark):
    rows = [(i, "hot text" if i % 3 == 0 else f"own text number {i}") for i in range(3000)]
    load = check(spark, rows, 6, bundles_per_shard=8)
    others = sorted(load.values())[:-1]
    assert others[-1] - others[0] < 0.25 * others[-1]


def test_longest_first_is_the_heap_rule():
    r = random.Random(1)
    items = [(i, r.randint(1, 1000)) for i in range(200)]
    placed = sh.longest_first(items, 7)
    load = Counter()
    for i, size in sorted(items, key=lambda x: (-x[1], x[0])):
        assert load[placed[i]] == min(load[s] for s in range(7))
        load[placed[i]] += size
