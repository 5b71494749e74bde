import zlib
from collections import Counter, defaultdict

from linkloom.llm import sharding
from oracle import duck, rows


def test_sql(spark, sf):
    assert rows(sharding.op4_rendezvous_shards(spark, sf).toPandas()) == rows(duck(sf, sharding.OP4_SQL))


def test_law_and_slots(spark, make):
    docs = make([(i, f"é{i}", "s") for i in range(3000)])
    got = sharding.shard(docs, [1.0] * 24).collect()
    by = defaultdict(list)
    for r in got:
        assert r.grown_shard in (r.shard, 24) and r.law == "key" and 0 <= r.shard < 24
        assert r.size == len(f"é{r.doc_id}".encode()) + 8 and r.text_crc32 == zlib.crc32(f"é{r.doc_id}".encode())
        by[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert len(by) == 24 and max(map(len, by.values())) < 2 * 3000 / 24
    moved = sum(r.grown_shard == 24 for r in got)
    assert 3000 / 25 / 2 < moved < 3000 / 25 * 2


def test_weights(spark, make):
    n = Counter(r.shard for r in sharding.shard(make([(i, "", "s") for i in range(4000)]), [1.0, 3.0, 0.0]).collect())
    assert 2 not in n and 2.5 < n[1] / n[0] < 3.5


def test_key_ranges(spark, make, monkeypatch):
    """Slots do not depend on how keys are cut into ranges."""
    docs = make([(i % 900, str(i), "s") for i in range(1000)])
    want = sorted(sharding.shard(docs, [1.0, 1.0]).collect())
    monkeypatch.setattr(sharding, "RANGE_ROWS", 7)
    assert sorted(sharding.shard(docs, [1.0, 1.0]).collect()) == want


def test_one_id_on_many_rows(spark, make, monkeypatch):
    """Rows of one id are numbered by several ranges, equal rows too."""
    monkeypatch.setattr(sharding, "RANGE_ROWS", 20)
    got = sharding.shard(make([(5, "t" * (i % 7), "s") for i in range(300)] + [(None, "long " * 50_000, "s")]), [1.0] * 4).where("doc_id = 5").collect()
    first = sorted(got, key=lambda r: r.slot)
    assert len({r.shard for r in got}) == 1 and [r.size for r in first] == sorted(r.size for r in got)
    assert {b.slot - a.slot for a, b in zip(first, first[1:])} == {1}


def test_edges(spark, make):
    got = sharding.shard(make([(None, None, None), (None, "a", "s"), (7, "t", "s"), (7, "t", "s"), (7, None, "s")]), [1.0] * 3).collect()
    assert len(got) == 5 and len({r.shard for r in got if r.doc_id == 7}) == 1
    assert {r.size for r in got if r.doc_id is None} == {8, 9}
    assert sharding.shard(make([]), [1.0] * 3).count() == 0
