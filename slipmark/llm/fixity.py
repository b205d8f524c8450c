"""Merkle fixity audit of WARC replicas: record digests, trees over ordered offset ranges, descent along mismatches."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slipmark.sources.scratch import stored

#: Bytes of a file that one leaf covers, and children of an inner node (a power of two).
LEAF_BYTES, FAN_BITS = 1 << 16, 4


def warc_records(pages: DataFrame, per_file: int = 1000, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """``page_id, file, offset, length, record``: pages as WARC resource records, ``per_file`` ids in a file.

    Offsets count bytes from the start of the file, in order of the id (then url and body); null urls and bodies are empty; a
    null id goes to a file of its own. A file is as large as ``per_file`` pages, so its window is.
    """
    body = F.coalesce(F.col(f"`{body_col}`").cast("string"), F.lit(""))
    url = F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    record = F.concat(head, body, F.lit("\r\n\r\n"))
    file = F.coalesce(F.concat(F.lit("crawl-"), F.expr(f"cast(`{id_col}` div {per_file} as string)"), F.lit(".warc")), F.lit("crawl-none.warc"))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), file.alias("file"), record.alias("record"))
    return placed(rows)


def placed(records: DataFrame) -> DataFrame:
    """The offset of each record in its file, from the bytes that are there before it, in the order of ``page_id``; of records, or
    of their digests (``digested``), which are all that then has to be shuffled."""
    if "record" in records.columns:
        records = records.withColumn("length", F.octet_length("record").cast("long"))
    last = "record" if "record" in records.columns else "entry"
    order = Window.partitionBy("file").orderBy("page_id", last).rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long"))


def digested(records: DataFrame) -> DataFrame:
    """The records without their bytes: ``entry`` (length and content digest) and ``name`` (the WARC-Record-ID) in place of ``record``."""
    text = F.coalesce("record", F.lit(""))
    length = F.col("length") if "length" in records.columns else F.octet_length("record").cast("long")
    name = F.regexp_extract(text, r"(?s)^WARC/[^\r\n]*\r\n(?:[^\r\n]+\r\n)*?WARC-Record-ID: *([^\r\n]+)", 1)
    entry = F.concat_ws(":", F.coalesce(length.cast("string"), F.lit("")), F.sha2(text, 256))
    return records.withColumn("length", length).withColumn("entry", entry).withColumn("name", name).drop("record")


def _fold(parts: str, order: str) -> Column:
    """Digest of the digests in order."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col(order), F.col(parts))))
    return F.sha2(F.array_join(F.transform(ordered, lambda e: F.concat_ws(":", e[order].cast("string"), e[parts])), "\n"), 256)


def leaf_entries(records: DataFrame, leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """``file, node, offset, entry, name``: each record's digest under the leaf of its offset.

    A record belongs to the offset range in which it begins, so a leaf holds at most as many records as bytes, whatever
    the size of the file. Records with equal offsets in a file are ordered by digest.
    """
    rows = digested(records) if "record" in records.columns else records
    return rows.where("file is not null and offset is not null").select(
        "file", F.expr(f"offset div {leaf_bytes}").alias("node"), "offset", "entry", "name")


def tree(entries: DataFrame, height: int) -> list[DataFrame]:
    """Node digests of each level over leaf entries, leaves first and the root of each file last."""
    level = stored(entries.groupBy("file", "node").agg(_fold("entry", "offset").alias("digest")), "fixity-level")
    levels = [level]
    for _ in range(height):
        up = level.select("file", F.shiftright("node", FAN_BITS).alias("up"), "node", "digest")
        level = stored(up.groupBy("file", F.col("up").alias("node")).agg(_fold("digest", "node").alias("digest")), "fixity-level")
        levels.append(level)
    return levels


def _differing(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    both = a.select(*keys, F.col(value).alias("va")).join(b.select(*keys, F.col(value).alias("vb")), keys, "full_outer")
    return both.where(~F.col("va").eqNullSafe(F.col("vb")))


def _numbered(rows: DataFrame, by: list[str]) -> DataFrame:
    """Equal records of a file are told apart by their order."""
    return rows.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("offset", "entry")))


def _pairs(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """The n-th record of ``by`` in ``a`` with the n-th one in ``b``: ``file, offset, second_offset, na, nb``."""
    side = lambda d, n, o: _numbered(d, by).select(*by, "k", F.col("row").alias(n), F.col("offset").alias(o), F.col("name").alias(f"name_{n}"))
    pairs = side(a, "na", "offset").join(side(b, "nb", "second_offset"), [*by, "k"])
    return pairs.select("file", "offset", "second_offset", "na", "nb", F.coalesce(F.nullif("name_na", F.lit("")), "name_nb").alias("name"))


def _rising(pdf: pd.DataFrame) -> pd.DataFrame:
    """The longest run of pairs whose offsets rise in both replicas."""
    pdf = pdf.sort_values(["offset", "na"], kind="stable")
    places = list(zip(pdf["second_offset"], pdf["nb"], strict=True))
    tails: list[tuple] = []
    last, before = [], [-1] * len(places)
    for i, place in enumerate(places):
        j = bisect_left(tails, place)
        tails[j : j + 1], last[j : j + 1] = [place], [i]
        before[i] = last[j - 1] if j else -1
    kept, i = [], last[-1]
    while i >= 0:
        kept.append(i)
        i = before[i]
    return pdf.iloc[kept[::-1]]


def _in_order(pairs: DataFrame) -> DataFrame:
    """Pairs in the same order on both sides. Only files in which some are not are looked at in a group of their own."""
    by_file = Window.partitionBy("file")
    ranked = pairs.withColumn("ra", F.row_number().over(by_file.orderBy("offset", "na"))).withColumn(
        "rb", F.row_number().over(by_file.orderBy("second_offset", "nb")))
    ranked = stored(ranked.withColumn("mixed", F.max(F.col("ra") != F.col("rb")).over(by_file)).drop("ra", "rb"), "fixity-pairs")
    schema = "file string, offset long, second_offset long, na long, nb long, name string"
    mixed = ranked.where("mixed").drop("mixed").groupBy("file").applyInPandas(_rising, schema)
    return stored(ranked.where("not mixed").drop("mixed").unionByName(mixed), "fixity-aligned")


def _with_gap(rows: DataFrame, pairs: DataFrame, number: str, offset: str) -> DataFrame:
    """Rows that are in no pair, with the number of pairs before them in their file."""
    marks = pairs.select("file", F.col(offset).alias("offset"), F.col(number).alias("row"), F.lit(1).alias("pair"))
    order = Window.partitionBy("file").orderBy("offset", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = rows.select("file", "offset", "row", "entry", "name", "size").join(marks, ["file", "offset", "row"], "left")
    return both.withColumn("gap", F.count("pair").over(order)).where("pair is null").drop("pair")


def audit(first: DataFrame, second: DataFrame, leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """Records that differ between two replicas: ``file, offset, status, second_offset, name``.

    Both have ``file, offset, length, record``, or are ``digested``. Each side is read once and builds its tree; roots are compared by file, and only the
    children of differing nodes are read further down, so equal files cost their root. Under the differing leaves the
    records of a file are then aligned, since one lost or added record moves all that follow: records of equal content are
    paired in order (the longest rising run where some are out of order), and what stands between two pairs is compared:

    * ``changed``: the record of the same WARC-Record-ID, or else of the same length, or else the next one, has other content;
    * ``moved``: the same content stands elsewhere in the file, out of order;
    * ``missing``: only the first replica has it; ``extra``: only the second one (``offset`` is then its place there).

    ``second_offset`` is the place in the second replica, null for missing records; ``name`` is the WARC-Record-ID. Rows with a null file or offset are not
    audited; a null record is an empty one; repeated equal records count, and one more or less of them is a change. Empty
    replicas differ in every record of the other; columns of other names are ignored. A very long record is one row.
    The records of one file are one group of their digests; many files are many tasks.
    """
    entries_a, entries_b = (stored(leaf_entries(d, leaf_bytes), "fixity-entries") for d in (first, second))
    reach = entries_a.select("node").union(entries_b.select("node")).agg(F.max("node")).first()[0] or 0
    height = 0
    while reach:
        reach >>= FAN_BITS
        height += 1
    levels_a, levels_b = tree(entries_a, height), tree(entries_b, height)
    nodes = _differing(levels_a[-1], levels_b[-1], ["file", "node"], "digest").select("file", "node")
    for a, b in zip(levels_a[-2::-1], levels_b[-2::-1], strict=True):
        nodes = stored(nodes, "fixity-nodes")
        parents = nodes.select("file", F.col("node").alias("up"))
        below = lambda level: (
            level.withColumn("up", F.shiftright("node", FAN_BITS)).join(parents, ["file", "up"], "left_semi")  # noqa: B023
        )
        nodes = _differing(below(a), below(b), ["file", "node"], "digest").select("file", "node")
    nodes = stored(nodes, "fixity-nodes")

    def held(entries: DataFrame) -> DataFrame:
        order = Window.partitionBy("file").orderBy("offset", "entry")
        rows = entries.join(nodes, ["file", "node"], "left_semi").withColumn("row", F.row_number().over(order).cast("long"))
        return stored(rows.withColumn("size", F.substring_index("entry", ":", 1)), "fixity-held")

    a, b = held(entries_a), held(entries_b)
    same = _in_order(_pairs(a, b, ["file", "entry"]))
    rest_a = stored(_with_gap(a, same, "na", "offset"), "fixity-rest")
    rest_b = stored(_with_gap(b, same, "nb", "second_offset"), "fixity-rest")
    out = None
    steps = [("moved", ["file", "entry"]), ("changed", ["file", "name"]), ("changed", ["file", "gap", "size"]), ("changed", ["file", "gap"])]
    for status, by in steps:
        named = lambda d: d.where("name <> ''") if "name" in by else d  # noqa: B023, E731
        met = stored(_pairs(named(rest_a), named(rest_b), by), "fixity-met")
        rest_a = rest_a.join(met.select("file", F.col("na").alias("row")), ["file", "row"], "left_anti")
        rest_b = rest_b.join(met.select("file", F.col("nb").alias("row")), ["file", "row"], "left_anti")
        rows = met.select("file", "offset", F.lit(status).alias("status"), "second_offset", "name")
        out = rows if out is None else out.unionAll(rows)
    missing = rest_a.select("file", "offset", F.lit("missing").alias("status"), F.lit(None).cast("long").alias("second_offset"), "name")
    extra = rest_b.select("file", "offset", F.lit("extra").alias("status"), F.col("offset").alias("second_offset"), "name")
    return out.unionAll(missing).unionAll(extra)
