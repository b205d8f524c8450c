import random
from difflib import SequenceMatcher

from slipmark.llm.fixity import audit, warc_records

SCHEMA = "file string, offset long, length long, record string, node string"


def plain(a, b):
    """The statuses by whole-file alignment: a longest common subsequence of the records, and pairs in what lies between."""
    out = set()
    for f in {r[0] for r in [*a, *b]} - {None}:
        x, y = (sorted((r[1], r[2], r[3] or "") for r in rows if r[0] == f and r[1] is not None) for rows in (a, b))
        blocks = SequenceMatcher(None, [r[1:] for r in x], [r[1:] for r in y], autojunk=False).get_opcodes()
        for kind, i, j, k, m in blocks:
            if kind == "equal":
                continue
            left, right = x[i:j], y[k:m]
            for r in list(left):  # of equal length first, then in order
                twin = next((q for q in right if q[1] == r[1]), None)
                if twin:
                    out.add((f, r[0], "changed", twin[0]))
                    left.remove(r), right.remove(twin)
            for r, q in zip(left, right):
                out.add((f, r[0], "changed", q[0]))
            out |= {(f, r[0], "missing", None) for r in left[len(right):]} | {(f, q[0], "extra", q[0]) for q in right[len(left):]}
    return out


def found(left, right, leaf=1 << 16):
    rows = audit(left, right, leaf).select("file", "offset", "status", "second_offset").collect()
    assert len(rows) == len(set(map(tuple, rows)))
    return {tuple(r) for r in rows}


def test_equals_plain(spark):
    a = [("hot", i * 37, 37, f"r{i}", "") for i in range(400)] + [("b", 0, 5, "x", ""), ("c", 9, 1, None, ""), ("d", 3, 3, "é", ""), ("d", 3, 3, "é", "")]
    a += [(None, 1, 1, "n", ""), ("e", None, 1, "n", "")]
    b = [r for r in a if r[1] != 370]
    b = [(f, o, n, "R" + (t or "") if o == 37 * 55 else t, x) for f, o, n, t, x in b] + [("new", 0, 1, "q", ""), ("hot", 10**9, 1, "far", "")]
    b.remove(("d", 3, 3, "é", ""))
    left, right = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA).repartition(3)
    for leaf in (64, 1 << 16):
        assert found(left, right, leaf) == plain(a, b)
    assert audit(left, left).count() == 0
    assert {r.status for r in audit(left, right.limit(0)).collect()} == {"missing"}
    assert {r.status for r in audit(left.limit(0), right).collect()} == {"extra"}
    assert audit(left.limit(0), left.limit(0)).count() == 0


def laid_out(file, texts):
    at, out = 0, []
    for t in texts:
        out.append((file, at, len(t), t, ""))
        at += len(t)
    return out


def test_a_lost_record_is_one_row_and_offsets_after_it_do_not_count(spark):
    texts = [f"record {i} " + "x" * (i * 7 % 50) for i in range(900)]
    without = texts[:100] + texts[101:]
    left = spark.createDataFrame(laid_out("f", texts), SCHEMA)
    lost = laid_out("f", texts)[100]
    assert found(left, spark.createDataFrame(laid_out("f", without), SCHEMA), 256) == {("f", lost[1], "missing", None)}
    added = laid_out("f", texts[:40] + ["new one"] + texts[40:])
    assert found(left, spark.createDataFrame(added, SCHEMA), 256) == {("f", added[40][1], "extra", added[40][1])}


def test_shifts_and_changes_equal_plain(spark):
    draw = random.Random(7)
    a, b = [], []
    for k in range(12):
        texts = [f"{k} {i} " + "y" * draw.randrange(60) for i in range(draw.randrange(1, 60))]
        other = []
        for t in texts:
            kind = draw.random()
            if kind < 0.05:
                continue
            other.append(t.replace("y", "z", 1) + "!" * draw.choice([0, 0, 3]) if kind < 0.12 else t)
            if kind > 0.95:
                other.append(f"more {draw.random()}")
        a += laid_out(f"f{k}", texts)
        b += laid_out(f"f{k}", other)
    left, right = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    want = plain(a, b)
    assert len(want) > 30 and found(left, right, 128) == want


def test_moved_records_and_record_names(spark):
    record = lambda i, body: f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:{i}>\r\n\r\n{body}"
    texts = [record(i, f"body {i} " + "x" * i) for i in range(20)]
    other = texts[:3] + texts[4:15] + [texts[3]] + texts[16:]  # 3 goes behind 14, and 15 is lost
    other[other.index(texts[5])] = record(5, "wholly other and longer text than before")
    a, b = laid_out("f", texts), laid_out("f", other)
    at = lambda rows, t: next(r[1] for r in rows if r[3] == t)
    assert found(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), 64) == {
        ("f", at(a, texts[3]), "moved", at(b, texts[3])), ("f", at(a, texts[15]), "missing", None),
        ("f", at(a, texts[5]), "changed", next(r[1] for r in b if "wholly" in r[3])),
    }


def test_offsets_are_those_of_the_written_file(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    files = {}
    for r in warc_records(pages, per_file=50).orderBy("file", "offset").collect():
        data = files.setdefault(r.file, bytearray())
        assert r.offset == len(data)
        data += r.record.encode()
        assert r.length == len(r.record.encode())
    odd = spark.createDataFrame([(None, None, None, 1), (1, "u", "é", 2), (1, "u", "é", 3)], "page_id long, url string, html string, offset long")
    assert warc_records(odd).count() == 3
