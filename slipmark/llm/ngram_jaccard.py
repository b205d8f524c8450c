"""N-gram Jaccard join: prefix filters under several global token orders, intersected before verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slipmark.llm.batches import id_bitmap, in_bitmap, list_array, mix, set_key, shingle_sets, slices
from slipmark.llm.components import components
from slipmark.sources.scratch import stored

#: Parts into which the rows of a component are dealt where components meet.
_SALTS = 8
#: Shingles counted together inside a task.
_COUNTED_TOGETHER = 1 << 21


def _prefix_length(n: int, percent: int) -> int:
    """Sets of n tokens that reach the similarity with another one share one of so many first tokens, in any order."""
    return n - -(-percent * n // 100) + 1 if n else 0


def _enough(overlap, a, b, percent: int):
    """overlap / (a + b - overlap) >= percent / 100."""
    return (100 + percent) * overlap >= percent * (a + b)


def frequent_tokens(
    texts: DataFrame, words: int = 5, min_docs: int = 8, capacity: int = 1 << 18
) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that many different texts hold, found over all texts: sorted by hash, and the rank of each by its count.

    A task counts the tokens of about two million shingles at a time, each set once, and reports those found more than
    once; the sums over tasks decide. At most ``capacity`` tokens, the most frequent ones, are returned: they only
    take part in the order of tokens, so any bound changes the cost and never the result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()
        size = 0

        def flush():
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts > 1
            return pa.RecordBatch.from_arrays(
                [pa.array(tokens[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], ["tok", "n"]
            )

        for batch in slices(batches, "text"):
            for tokens in shingle_sets(batch.column("text"), words):
                if len(tokens) and (key := set_key(tokens)) not in seen:
                    seen.add(key)
                    held.append(tokens)
                    size += len(tokens)
            if size >= _COUNTED_TOGETHER:
                yield flush()
                held, size = [], 0
                seen.clear()
        if held:
            yield flush()

    rows = (
        texts.select("text").mapInArrow(count, "tok long, n long")
        .groupBy("tok").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs)
        .orderBy(F.desc("n"), "tok").limit(capacity).select("tok").collect()
    )
    tokens = np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64)
    by_hash = np.argsort(tokens)
    # rows come with the most frequent one first; the rarest has rank 0
    return tokens[by_hash], len(tokens) - 1 - by_hash


def _is_in(tokens: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(tokens), dtype=bool)
    at = np.minimum(np.searchsorted(ordered, tokens), len(ordered) - 1)
    return ordered[at] == tokens


def _prepare(texts: DataFrame, frequent: np.ndarray, rank: np.ndarray, words: int, percent: int) -> DataFrame:
    """Per text: set size and key, frequent tokens in the set, and its prefix in the first order (rare tokens by hash,
    then frequent ones by their counts), cut in its rare and its frequent part. A set that a task has met before has no
    prefix."""
    schema = "doc_id long, n long, k long, h long, rare array<long>, often array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches, "text"):
            n, key, hot, rare, often = [], [], [], [], []
            for tokens in shingle_sets(batch.column("text"), words):
                n.append(len(tokens))
                if not len(tokens):
                    key.append(None), hot.append(0), rare.append(None), often.append(None)
                    continue
                key.append(set_key(tokens))
                flag = _is_in(tokens, frequent)
                hot.append(int(flag.sum()))
                if key[-1] in seen:
                    rare.append(None), often.append(None)
                    continue
                seen.add(key[-1])
                p = _prefix_length(len(tokens), percent)
                first = tokens[~flag][:p]
                rare.append(first.view(np.int64))
                last = tokens[flag]
                by_count = np.argsort(rank[np.searchsorted(frequent, last)])
                often.append(last[by_count[: p - len(first)]].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(key, pa.int64()), pa.array(hot, pa.int64()),
                    list_array(rare, pa.int64()), list_array(often, pa.int64()),
                ],
                ["doc_id", "n", "k", "h", "rare", "often"],
            )

    return texts.mapInArrow(run, schema)


def _order(tokens: np.ndarray, seed: int) -> np.ndarray:
    """Places of tokens in another global order, as 32-bit numbers; equal numbers only weaken the filter."""
    return np.sort((mix(tokens ^ np.uint64(seed)) >> np.uint64(32)).astype(np.uint32))


#: Seeds of the further orders.
ORDERS = (0x51ED270B7F4A7C15, 0x2545F4914F6CDD1D)


#: Bits of the smallest and the largest parity sketch.
_SKETCH_BITS = (1 << 8, 1 << 12)


def _sketch(tokens: np.ndarray) -> np.ndarray:
    """Parity of the tokens that fall on each of about as many bits as there are tokens (a power of two)."""
    bits = min(max(_SKETCH_BITS[0], 1 << (max(len(tokens), 1) - 1).bit_length()), _SKETCH_BITS[1])
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def _near(a: str, b: str, na: str, nb: str, percent: int):
    """Tokens of one set only are at least as many as the bits in which two sketches differ. The halves of a sketch combine to
    the one of half the length; the lengths of two sets of similar size differ by one halving at most."""
    short = F.least(F.size(a), F.size(b))

    def cut(x: str):
        halves = F.zip_with(F.slice(x, F.lit(1), short), F.slice(x, short + 1, short), lambda u, v: u.bitwiseXOR(v))
        return F.when(F.size(x) > short, halves).otherwise(F.col(x))

    apart = F.aggregate(
        F.zip_with(cut(a), cut(b), lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda t, x: t + x
    )
    return _sizes(percent, na, nb) & ((100 + percent) * apart <= (100 - percent) * (F.col(na) + F.col(nb)))


def _prefixes(texts: DataFrame, needed: np.ndarray, words: int, percent: int) -> DataFrame:
    """Prefixes in the further orders and sketches, of the texts in the bitmap."""
    names = [f"o{i}" for i in range(len(ORDERS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(_only(batches, needed), "text"):
            sets = shingle_sets(batch.column("text"), words)
            columns = [
                pa.array([_order(t, seed)[: _prefix_length(len(t), percent)].tobytes() for t in sets], pa.binary())
                for seed in ORDERS
            ]
            sketches = list_array([_sketch(t) for t in sets], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t) for t in sets], pa.int64()), *columns, sketches],
                ["id", "n", *names, "sketch"],
            )

    return texts.mapInArrow(run, "id long, n long, " + ", ".join(f"{x} binary" for x in names) + ", sketch array<long>")


def _only(batches: Iterator[pa.RecordBatch], needed: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array(in_bitmap(needed, batch.column("doc_id"))))


def _may_reach(a: bytes, b: bytes, na: int, nb: int, percent: int) -> bool:
    """Below the smaller last place of two prefixes both sets are known: tokens there that only one set has, and what
    is left behind, bound the overlap."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    if not len(x) or not len(y):
        return False
    shared = np.isin(x, y)
    if not shared.any():
        return False
    last = min(x[-1] if len(x) < na else np.iinfo(np.uint32).max, y[-1] if len(y) < nb else np.iinfo(np.uint32).max)
    i, j = int(np.searchsorted(x, last)), int(np.searchsorted(y, last))
    most = min(int(shared[:i].sum()) + na - i, nb)
    return _enough(min(most, nb - j + int(np.isin(y[:j], x[:i]).sum())), na, nb, percent)


def _filter(pairs: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """Pairs that pass the prefix filter in every further order, one order after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[batch.column(c).to_pylist() for c in ("pa", "pb", "na", "nb")], strict=True)
            keep = [_may_reach(x, y, na, nb, percent) for x, y, na, nb in rows]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    for i in range(len(ORDERS)):
        side = lambda s: prefixes.select(
            F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col(f"o{i}").alias(f"p{s}")  # noqa: B023
        )
        pairs = pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long").distinct()
    return pairs


def _verify(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs whose whole sets reach the similarity. Only texts of these pairs move, chosen by a bitmap of fixed size."""
    needed = id_bitmap(pairs.select(F.explode(F.array("a", "b")).alias("id")), "id")
    wanted = texts.mapInArrow(lambda batches: _only(batches, needed), "doc_id long, text string")
    side = lambda s: wanted.select(F.col("doc_id").alias(s), F.col("text").alias(f"t{s}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(slices([whole], "ta"), "tb"):
                keep = []
                for x, y in zip(shingle_sets(batch.column("ta"), words), shingle_sets(batch.column("tb"), words), strict=True):
                    overlap = int(_is_in(x, y).sum())
                    keep.append(overlap > 0 and _enough(overlap, len(x), len(y), percent))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long").distinct()


def _sizes(percent: int, a: str, b: str):
    return (100 * F.least(a, b) >= percent * F.greatest(a, b))


def _hot_sizes(percent: int, n1: str, n2: str, h1: str, h2: str):
    """Two sets that share frequent tokens only overlap by the smaller number of these at most."""
    return _sizes(percent, n1, n2) & ((100 + percent) * F.least(h1, h2) >= percent * (F.col(n1) + F.col(n2)))


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75,
    min_docs: int = 8, capacity: int = 1 << 18, light: int = 64,
) -> DataFrame:
    """One row for each input row: ``doc_id``, ``n_shingles``, ``component_id``, ``set_key`` (equal for equal sets; null for empty).

    Texts link when their sets of distinct word shingles (64-bit fingerprints) reach a Jaccard similarity of
    ``percent`` / 100; ``component_id`` is the smallest id reachable. A text without words, or null, has no shingles and
    its own id; a null id has a null component; repeated rows are kept and share their component; other columns are ignored.

    * Equal sets are one class, of the smallest id.
    * First order: tokens by hash, frequent ones last, by their counts. Texts that share a rare prefix token are candidates.
    * Texts whose prefix reaches the frequent tokens are large groups of near copies, or little but shared passages. The one
      with the largest share of frequent tokens in a token's texts is its centre: all are compared with centres first,
      and then only texts of different components, of which those with too different parity sketches are no candidates.
    * A rare prefix token with more than ``light`` postings goes the same way as a frequent one; the postings are counted
      where they meet, so this has no bound.
    * Further orders: the candidates must also pass the prefix filter in each of these; then whole sets decide.
    """
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    frequent, rank = frequent_tokens(texts, words, min_docs, capacity)
    prep = stored(_prepare(texts, frequent, rank, words, percent), "jaccard-prefixes")
    classes = prep.where("k is not null").groupBy("k").agg(F.min("doc_id").alias("id"))
    classes = stored(classes.where("id is not null"), "jaccard-classes")

    by_token = Window.partitionBy("tok")
    shared = (
        prep.where("rare is not null").select("k", "n", F.explode("rare").alias("tok"))
        .select("tok", "k", "n", F.min("k").over(by_token).alias("lo"), F.max("k").over(by_token).alias("hi"),
                F.count("*").over(by_token).alias("m"))
        .where("lo <> hi").select("tok", "k", "n", (F.col("m") <= light).alias("few")).distinct()
    )
    shared = stored(shared.join(classes, "k").select("tok", "id", "n", "few"), "jaccard-postings")
    one, two = (shared.where("few").select("tok", F.col("id").alias(x), F.col("n").alias(f"n{x}")) for x in "ab")
    rare_pairs = one.join(two, "tok").where((F.col("a") < F.col("b")) & _sizes(percent, "na", "nb")).select("a", "b").distinct()

    dense = prep.where("size(often) > 0").select("k", "n", "h", F.explode("often").alias("tok")).distinct()
    # texts that meet in a rare token may share any of their tokens
    many = shared.where("not few").select("tok", "id", "n", F.col("n").alias("h"))
    dense = stored(dense.join(classes, "k").select("tok", "id", "n", "h").union(many), "jaccard-dense")
    first = F.struct((F.col("h") / F.col("n")).alias("share"), "n", "id")
    centres = dense.groupBy("tok").agg(F.max_by(F.struct("id", "n", "h"), first).alias("c"))
    stars = (
        dense.join(centres, "tok").select("id", "n", "h", F.col("c.id").alias("cid"),
            F.col("c.n").alias("cn"), F.col("c.h").alias("ch"))
        .where((F.col("id") != F.col("cid")) & _hot_sizes(percent, "n", "cn", "h", "ch"))
        .select(F.least("id", "cid").alias("a"), F.greatest("id", "cid").alias("b"))
    )
    pairs = stored(rare_pairs.union(stars).distinct(), "jaccard-pairs")
    needed = id_bitmap(pairs.select(F.explode(F.array("a", "b")).alias("id")).union(dense.select("id")), "id")
    prefixes = stored(_prefixes(texts, needed, words, percent), "jaccard-orders")
    links = stored(_verify(stored(_filter(pairs, prefixes, percent), "jaccard-kept"), texts, words, percent), "jaccard-links")
    labels = components(links, "a", "b", "jaccard-components")

    # what is left of the dense texts: those of different components under a common token
    members = (
        dense.join(labels, dense.id == labels.node, "left")
        .select("tok", "id", "n", "h", F.coalesce("label", "id").alias("label"))
    )
    here = members.select("tok", "label").distinct()
    mixed = here.groupBy("tok").agg(F.count("*").alias("m")).where("m > 1").select("tok")
    members = stored(members.join(mixed, "tok", "left_semi"), "jaccard-members")
    each = members.select("id", "n", "h", "label").distinct()
    # of two components, the texts of the smaller one look for the larger one; a large component's rows are dealt by salt
    sizes = each.groupBy("label").agg(F.struct(F.count("*").alias("c"), "label").alias("size"))
    salted = sizes.select("label", "size", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64("id"), F.lit(_SALTS)).cast("int").alias("salt")
    there = (
        members.groupBy("tok", "label").agg(F.max("h").alias("oh"), F.min("n").alias("least"), F.max("n").alias("most"))
        .join(sizes, "label").select("tok", F.col("label").alias("other"), F.col("size").alias("larger"), "oh", "least", "most")
    )
    towards = (
        members.select("*", salt).join(salted, ["label", "salt"]).join(there, "tok")
        .where((F.col("size") < F.col("larger")) & (100 * F.col("n") >= percent * F.col("least"))
               & (100 * F.col("most") >= percent * F.col("n"))
               & ((100 + percent) * F.least("h", "oh") >= percent * (F.col("n") + F.greatest("least", F.ceil(F.col("n") * percent / 100)))))
        .select("id", "n", "h", "other").distinct()
    )
    sketches = prefixes.select("id", "n", "sketch").distinct()
    others = (
        each.join(sketches, ["id", "n"]).select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("h").alias("hb"),
            F.col("sketch").alias("sb"), F.col("label").alias("other"), salt)
    )
    towards = towards.join(sketches, ["id", "n"]).select("*", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    rest = stored(
        towards.join(others, ["other", "salt"])
        .where(_hot_sizes(percent, "n", "nb", "h", "hb") & _near("sketch", "sb", "n", "nb", percent))
        .select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct(),
        "jaccard-rest",
    )
    kept = stored(_filter(rest, prefixes, percent), "jaccard-rest-kept")
    if not kept.isEmpty():
        more = _verify(kept, texts, words, percent)
        labels = components(
            links.union(more), "a", "b", "jaccard-components"
        )
    return (
        prep.select("doc_id", "n", "k").join(classes, "k", "left").join(labels, F.col("id") == labels.node, "left")
        .select("doc_id", F.col("n").alias("n_shingles"),
                F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "id", "doc_id")).alias("component_id"), F.col("k").alias("set_key"))
    )


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows and columns of ``docs`` whose id is the smallest of its component; rows with a null id stay.

    Of rows with one id and equal sets one stays; rows with one id and different sets are different documents, and all stay
    that are not near copies of a smaller id's. No column but the id and the text decides which of equal rows stays.
    """
    groups = jaccard_components(docs, id_col, text_col)
    kept = groups.where("component_id = doc_id").groupBy("doc_id").agg(F.count("*").alias("rows"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    ident, text = (names[docs.columns.index(c)] for c in (id_col, text_col))
    # an id of one row needs no comparison; of the others the texts' sets are told apart by their words
    stay = plain.join(kept, F.col(ident) == F.col("doc_id"), "left_semi")
    several = kept.where("rows > 1").select("doc_id")
    single = stay.join(several, F.col(ident) == F.col("doc_id"), "left_anti")
    repeated = stay.join(several, F.col(ident) == F.col("doc_id"), "left_semi")
    one = single.unionByName(_first_of_each_set(repeated, ident, text))
    return one.unionByName(plain.where(F.col(ident).isNull())).toDF(*docs.columns)


def _first_of_each_set(rows: DataFrame, ident: str, text: str, words: int = 5) -> DataFrame:
    """One row of each id and shingle set; texts without words are one set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            keys = [set_key(t) if len(t) else None for t in shingle_sets(batch.column(text), words)]
            yield batch.append_column("_set", pa.array(keys, pa.int64()))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", _set long"
    return rows.mapInArrow(run, schema).dropDuplicates([ident, "_set"]).drop("_set")


