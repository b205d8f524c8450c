"""Benchmark decontamination by canonical templates: typed placeholders, hash-joined windows, slot consistency."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slipmark.llm.batches import id_bitmap, in_bitmap, mix, slices, span_hashes, text_bytes, windows, word_spans
from slipmark.sources.scratch import stored

#: Unit words, which count as units right after a number.
UNITS = (
    "km m cm mm mile miles meter meters metre metres inch inches foot feet yard yards kg g mg gram grams pound pounds lb lbs oz "
    "ounce ounces ton tons liter liters litre litres ml l gallon gallons cup cups second seconds minute minutes hour hours "
    "day days week weeks month months year years dollar dollars cent cents euro euros percent degree degrees mph kmh"
).split()
_NUMBER, _NAME, _UNIT = (mix(np.array([i], dtype=np.uint64))[0] for i in (101, 102, 103))
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_INSIDE = _DIGIT | _UPPER
_INSIDE[97:123] = True
_INSIDE[128:] = True
_POINT = np.zeros(256, dtype=bool)
_POINT[[0x2C, 0x2E]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[0x0A, 0x21, 0x2E, 0x3A, 0x3F]] = True


def _lowered(data: np.ndarray) -> np.ndarray:
    return np.where(_UPPER[data], data + 32, data).astype(np.uint8)


def _unit_hashes() -> np.ndarray:
    joined = np.frombuffer("".join(UNITS).encode(), dtype=np.uint8)
    ends = np.cumsum([len(u) for u in UNITS])
    return span_hashes(joined, np.concatenate([[0], ends[:-1]]), ends)


def canonical(column: pa.Array):
    """Lower-cased bytes, token starts and ends, plain and canonical token hashes, slot flags, and each text's first token.

    Tokens are runs of letters and digits, and numbers with points or commas inside. A number, a capitalised word that
    does not begin a sentence, and a unit right after a number become placeholders of their type.
    """
    data, offsets = text_bytes(column)
    inside = _INSIDE[data]
    if len(data) > 2:  # a point or comma between two digits is part of a number
        digit = _DIGIT[data]
        inside[1:-1] |= _POINT[data[1:-1]] & digit[:-2] & digit[2:]
    starts, ends, at = word_spans(inside, offsets)
    low = _lowered(data)
    hashes = span_hashes(low, starts, ends)
    if not len(starts):
        return low, starts, ends, hashes, hashes, np.zeros(0, dtype=bool), at
    numeric = np.concatenate([[0], np.cumsum(_DIGIT[data] | _POINT[data])])
    number = (numeric[ends] - numeric[starts] == ends - starts) & _DIGIT[data[starts]]
    stops = np.concatenate([[0], np.cumsum(_STOP[data])])
    before = np.concatenate([[0], ends[:-1]])
    first = np.zeros(len(starts), dtype=bool)
    first[at[:-1][at[:-1] < len(starts)]] = True
    first |= stops[starts] > stops[np.minimum(before, starts)]
    name = _UPPER[data[starts]] & ~first
    unit = np.zeros(len(starts), dtype=bool)
    unit[1:] = number[:-1] & np.isin(hashes[1:], _unit_hashes()) & ~first[1:]
    masked = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, hashes)))
    return low, starts, ends, hashes, masked, number | name | unit, at


def _window_rows(texts: DataFrame, id_type: str, sizes: list[int], least_literal: int, known: np.ndarray | None, every: bool) -> DataFrame:
    """``id, pos, hash, size, held, slots, slot_at`` of the windows in the bitmap ``known`` (all windows where it is None).

    Each window is there with its plain lower-cased tokens; one that has slots and enough literal tokens is there with
    placeholders too, and the slots' values and places. ``held`` is the number of slots in either case.
    """
    id_arrow = {"bigint": pa.int64(), "string": pa.string()}[id_type]
    schema = f"id {id_type}, pos int, hash long, size int, held int, slots array<string>, slot_at array<int>"
    names = ["id", "pos", "hash", "size", "held", "slots", "slot_at"]
    types = [id_arrow, pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            low, starts, ends, plain, masked, slot, at = canonical(batch.column("text"))
            ids = batch.column("id")
            counts = np.diff(at)
            slots_before = np.concatenate([[0], np.cumsum(slot)])
            out = []
            for size in sizes:
                if len(plain) < size:
                    continue
                places = np.arange(len(plain) - size + 1)
                text = np.searchsorted(at, places, side="right") - 1
                whole = places + size <= at[text + 1]
                if every:  # benchmark items: windows of the full size, or one of the whole item where it is shorter
                    whole &= (size == sizes_max) | (counts[text] == size)
                held = slots_before[places + size] - slots_before[places]
                enough = whole & (held > 0) & (size - held >= min(least_literal, size))
                for hashes, keep, with_slots in ((plain, whole, False), (masked, enough, True)):
                    found = (windows(hashes, size) + np.uint64(size)).view(np.int64)
                    if known is not None:
                        keep[keep] = in_bitmap(known, pa.array(found[keep]))
                    for i in np.flatnonzero(keep):
                        t = int(text[i])
                        inside = [j for j in range(i, i + size) if slot[j]] if with_slots else []
                        values = [low[starts[j] : ends[j]].tobytes().decode("utf-8", "replace") for j in inside]
                        out.append([ids[t].as_py(), int(i - at[t]), int(found[i]), size, int(held[i]), values, [int(j - at[t]) for j in inside]])
            columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], names)

    sizes_max = max(sizes)
    return texts.mapInArrow(run, schema)


def _probes(asked: DataFrame, least_share: float) -> DataFrame:
    """``item_id, hash``: windows of which a text must hold one to reach ``least_share`` of the item's.

    Where ``need`` of n places must be found, at least one of any n - need + 1 is among them: those whose windows the fewest
    items share are taken. So a phrase that all items of a templated benchmark have brings no pairs by itself.
    """
    common = asked.groupBy("hash").agg(F.countDistinct("item_id").alias("items"))
    known = asked.join(common, "hash")
    out = None
    for part in (known.where(F.size("item_slots") == 0), known.where("typed")):
        places = part.groupBy("item_id", "at").agg(F.max("items").alias("items"))
        by_item = Window.partitionBy("item_id")
        n = F.count("*").over(by_item)
        rarest = places.withColumn("place", F.row_number().over(by_item.orderBy("items", "at"))).withColumn("n", n)
        chosen = rarest.where(F.col("place") <= F.col("n") - F.ceil(F.lit(least_share) * F.col("n")) + 1).select("item_id", "at")
        rows = part.join(chosen, ["item_id", "at"]).select("item_id", "hash")
        out = rows if out is None else out.unionAll(rows)
    return out.distinct()


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = 8, least_literal: int = 4, least_share: float = 0.6,
) -> DataFrame:
    """Texts that hold a benchmark item, or one with other numbers, names and units: ``id_col, item_id, share, exact``.

    A window has ``window`` tokens; an item that is shorter is one window. Windows are joined by hash with the item's: plain
    ones (lower-cased, any tokens) and canonical ones with at least ``least_literal`` literal tokens. On one alignment (place
    in the text minus place in the item) each slot value of the item is bound to the value of the text that it meets at most
    places; canonical windows with another value are dropped, unless all their values are the item's own. ``share`` is the larger one
    of: places found plainly, of all; places found at all, of those that can be found with other values. A row is reported from
    ``least_share`` on; ``exact`` tells that all windows found hold the item's own values. Rows with a null id, text
    or item give none; repeated rows are reported once; items with the same text are all reported; other columns are ignored.
    Very long texts are handled alone; ties between bindings go to the larger value.

    Of the texts only windows in a bitmap of fixed size leave the first task. Pairs of text and item come from the
    item's rarest windows (see ``_probes``), and all windows are looked at only for these pairs.
    """
    kind = dict(docs.dtypes)[id_col]
    kind = "bigint" if kind in ("tinyint", "smallint", "int", "bigint") else "string"
    texts = docs.select(F.col(f"`{id_col}`").cast(kind).alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("id is not null")
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("id"), F.col(f"`{item_text_col}`").cast("string").alias("text")).where("id is not null")
    sizes = list(range(1, window + 1))
    asked = _window_rows(items, "bigint", sizes, least_literal, None, True)
    asked = asked.select(F.col("id").alias("item_id"), F.col("pos").alias("at"), "hash", "size", "held", F.col("slots").alias("item_slots"), "slot_at").distinct()
    # with other values a place can be found where its window has no slot, or has its placeholders too
    free = (F.size("item_slots") > 0) | (F.col("held") == 0)
    asked = stored(asked.withColumn("typed", F.max(free).over(Window.partitionBy("item_id", "at"))), "item-windows")
    total = asked.groupBy("item_id").agg(F.countDistinct("at").alias("windows"), F.countDistinct(F.when(F.col("typed"), F.col("at"))).alias("typed_windows"))
    present = sorted(r[0] for r in asked.select("size").distinct().collect())  # at most ``window`` values
    if not present:
        return texts.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("item_id"), F.lit(0.0).alias("share"), F.lit(True).alias("exact")).where("false")
    known = id_bitmap(asked.select("hash"), "hash")
    held = stored(_window_rows(texts, kind, present, least_literal, known, False).select("id", "pos", "hash", "slots").distinct(), "text-windows")
    probes = _probes(asked, least_share)
    asked_pairs = held.join(probes, "hash").select("id", "item_id").distinct()
    pairs = held.join(asked_pairs, "id").join(asked, ["item_id", "hash"]).where(F.size("slots") == F.size("item_slots"))
    met = F.transform(F.arrays_zip("slot_at", "item_slots", "slots"), lambda z: F.struct(z["slot_at"].alias("p"), z["item_slots"].alias("a"), z["slots"].alias("b")))
    one = F.struct("at", "typed", F.size("slots").alias("n"), met.alias("met"))
    aligned = pairs.groupBy("id", "item_id", (F.col("pos") - F.col("at")).alias("shift")).agg(F.collect_set(one).alias("found"))
    aligned = aligned.withColumn("all", F.array_distinct(F.flatten(F.transform("found", lambda w: w["met"]))))
    pair = lambda m: F.struct(m["a"].alias("a"), m["b"].alias("b"))
    votes = F.transform(
        F.array_distinct(F.transform("all", pair)),
        lambda x: F.struct(x["a"].alias("a"), F.size(F.filter("all", lambda m: (m["a"] == x["a"]) & (m["b"] == x["b"]))).alias("n"), x["b"].alias("b")),
    )
    aligned = aligned.withColumn("votes", votes)
    more = lambda y, x: (y["a"] == x["a"]) & ((y["n"] > x["n"]) | ((y["n"] == x["n"]) & (y["b"] > x["b"])))
    aligned = aligned.withColumn("bound", F.transform(F.filter("votes", lambda x: ~F.exists("votes", lambda y: more(y, x))), pair))
    own = lambda w: F.forall(w["met"], lambda m: m["a"] == m["b"])
    fits = lambda w: own(w) | F.forall(w["met"], lambda m: F.array_contains(F.col("bound"), pair(m)))
    kept = aligned.select("id", "item_id", F.explode(F.filter("found", fits)).alias("w"))
    shares = kept.groupBy("id", "item_id").agg(
        F.countDistinct(F.when(F.col("w.n") == 0, F.col("w.at"))).alias("plain"), F.countDistinct(F.when(F.col("w.typed"), F.col("w.at"))).alias("any"),
        F.min(own(F.col("w"))).alias("exact"))
    share = F.greatest(F.col("plain") / F.col("windows"), F.coalesce(F.try_divide("any", "typed_windows"), F.lit(0.0)))
    return (
        shares.join(total, "item_id").withColumn("share", share).where(F.col("share") >= least_share)
        .select(F.col("id").alias(id_col), "item_id", "share", "exact")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows and columns of ``docs`` without those that hold an item. Rows are told apart by their text's digest.

    Null and empty texts and all copies of a clean text stay, copies of a leaking one all go; columns may have any names.
    """
    key = F.sha2(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), 256)
    keyed = docs.select(key.alias("key"), F.col(f"`{text_col}`").alias("text"))
    bad = find_leaks(keyed, benchmark, "key").select(F.col("key").alias("bad")).distinct()
    return docs.join(bad, key == bad["bad"], "left_anti")
