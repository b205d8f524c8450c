import heapq
import random
from collections import defaultdict

from llm.brute import WORD

from slipmark.llm.mixing import apportion, mix


def plain_seats(votes, seats):
    heap = [(-v, p, 0) for p, v in votes.items() if v > 0]
    heapq.heapify(heap)
    out = defaultdict(int)
    for _ in range(seats if heap else 0):
        _, p, k = heapq.heappop(heap)
        out[p] += 1
        heapq.heappush(heap, (-votes[p] / (2 * (k + 1) + 1), p, k + 1))
    return dict(out)


def test_apportion_equals_highest_quotients(spark):
    draw = random.Random(2)
    groups = {"g1": {f"p{i:02}": float(draw.randrange(1, 10_000)) for i in range(25)}, "g2": {"a": 5.0, "b": 5.0, "c": 5.0},
              "g3": {"x": 1.0}, "g4": {"a": 1e9, "b": 1.0}, "g5": {"z": 0.0}}
    seats = {"g1": 777, "g2": 4, "g3": 9, "g4": 5, "g5": 3}
    parties = spark.createDataFrame([(g, p, v) for g, ps in groups.items() for p, v in ps.items()], "grp string, party string, votes double")
    rows = apportion(parties, spark.createDataFrame(list(seats.items()), "grp string, seats long")).collect()
    for g, votes in groups.items():
        assert {r.party: r.quota for r in rows if r.grp == g and r.quota} == plain_seats(votes, seats[g])


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = [s for s in names if s not in capped]
        room = total - sum(3 * sizes[s] for s in capped)
        target = {s: room * weight[s] / sum(weight[x] for x in left) if s in left else 3.0 * sizes[s] for s in names} if left else {s: 3.0 * sizes[s] for s in names}
        new = {s for s in left if target[s] > 3 * sizes[s]}
        if not new:
            return target
        capped |= new


def check(rows, texts, block=16):
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    assert sorted(r.size for r in rows) == sorted(len(WORD.findall(t or "")) for t in texts)
    target = plain_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 * (1 + r.target)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 2 * block + 0.001 * target[s], (s, taken[s], target[s])


def test_given_documents_and_reruns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mix(docs, shard_words=20_000).collect()
    check(rows, [r.text for r in docs.collect()])
    again = mix(docs.repartition(5), shard_words=20_000).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)


def test_small_hot_null_and_empty_sources(spark):
    draw = random.Random(4)
    rows = [(i, "w " * draw.randrange(0, 30), None if i % 9 == 0 else "big" if i % 3 else f"s{i % 7}", "x") for i in range(800)]
    rows += [(None, "a b", "é", "x"), (5, None, "nothing", "x"), (5, None, "nothing", "x"), (900, "one", "tiny", "x"), (900, "one", "tiny", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, skey string")
    out = mix(df, shard_words=500).collect()
    assert len(out) == len(rows)
    check(out, [r[1] for r in rows], block=16 * 2)
    assert mix(df.limit(0)).count() == 0
    assert [r.taken for r in mix(df.where("source = 'nothing'")).collect()] == [0, 0]
