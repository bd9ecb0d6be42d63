"""N-gram Jaccard join by PartEnum signatures: exact links between shingle sets, as components.

Documents with equal sets form a class, and classes are joined, so copies never become pairs.
Classes of similar size that are similar enough share a signature (`jaccard_sig`). Three exact steps
follow, none of which enumerates the pairs of a crowded signature:

1. each class of a signature is verified against the smallest class there; links make components. Classes that meet
   within one batch of rows are held against the smallest of the batch, and only that one meets other batches under the
   signature, so a signature costs one task a row for each batch and the others are dealt by a key of their own;
2. where a signature of few rows still holds several components, the pairs between them are verified;
3. classes of crowded signatures with several components meet again on their rarest shingles (prefix
   filter, rarest first among those classes): each is first verified against the smallest class that has
   the shingle, and of what is still apart only pairs that pass the bounds on sizes and places are taken.

Before shingles are fetched, a pair must pass a bound on bitmaps that grow with the sets (the bits that
differ never outnumber the shingles that do).

Nulls and texts without words have an empty set and link with nothing; a text of fewer words than
a shingle has one shingle, the whole; repeated rows are copies and each is returned; other columns
are ignored; an empty table gives no rows. Rows with a null id link as all others do; a null id never names a component
unless all ids of its component are null. Equality of shingles and sets is that of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logsignals.llm.components import components
from logsignals.llm.jaccard_sig import signatures
from logsignals.llm.textual import digest_of, saved, shingles_of, table, words_of

#: Rows up to which the pairs of one signature are formed; the others go through the prefix filter. Either way is exact.
CROWDED = 16
#: Rows whose shingles are wanted, up to which they are broadcast as a filter (some 50 MB); beyond, a shuffled join.
BROADCAST_MARKS = 1_000_000
LEAST_BITS = 256
#: Signatures or shingles that a task holds before it hands them on.
HELD = 500_000


def _members(size: int):
    """For mapInArrow over (doc_id, mark, text): class, number of shingles and bitmap of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, n, bits = [], [], []
            for text in batch.column(2):
                shingles = shingles_of(words_of(text.as_py()), size)
                cls.append(digest_of(shingles))
                n.append(len(shingles))
                bits.append(_bitmap(shingles))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cls, pa.int64()), pa.array(n, pa.int64()), pa.array(bits, pa.binary())], ["doc_id", "mark", "cls", "n", "bits"])

    return run


def _signature_rows(size: int, percent: int):
    """For mapInArrow over text: (key, cls, via). Of the classes of some HELD signatures, the smallest of each signature has that as its key, and an empty via if there are others; those have (signature, smallest) in via and a key of their own."""

    def dealt(sigs: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        cls = np.repeat(np.fromiter(sigs, np.int64, len(sigs)), [len(x) for x in sigs.values()])
        sig = np.concatenate(list(sigs.values())).view(np.int64)
        order = np.lexsort((cls, sig))
        first = np.append(True, sig[order][1:] != sig[order][:-1])
        least, alone = np.empty_like(cls), np.empty(len(cls), bool)
        least[order], alone[order] = cls[order][np.flatnonzero(first)[np.cumsum(first) - 1]], first
        more = np.empty(len(cls), bool)
        more[order] = first & ~np.append(first[1:], True)
        yield _rows(sig[alone], cls[alone], np.zeros(alone.sum(), np.int64), np.empty(0, np.int64), ~more[alone])  # in the order of classes, which compresses well
        if not alone.all():
            with np.errstate(over="ignore"):
                own = sig[~alone] + cls[~alone] * np.int64(0x9E3779B1)
            yield _rows(own, cls[~alone], np.full(len(own), 2), np.stack([sig[~alone], least[~alone]], 1).ravel())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs: dict[int, np.ndarray] = {}
        total = 0
        for batch in batches:
            for text in batch.column(0):
                shingles = shingles_of(words_of(text.as_py()), size)
                if len(shingles) and (cls := digest_of(shingles)) not in sigs:
                    sigs[cls] = np.unique(signatures(shingles, percent))
                    total += len(sigs[cls])
                    if total > HELD:  # memory
                        yield from dealt(sigs)
                        sigs, total = {}, 0
        if sigs:
            yield from dealt(sigs)

    return run


def _rows(key: np.ndarray, cls: np.ndarray, sizes: np.ndarray, via: np.ndarray, none: np.ndarray | None = None) -> pa.RecordBatch:
    held = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(via), mask=None if none is None else pa.array(none))
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(cls), held], ["key", "cls", "via"])


def _sets(size: int):
    """For mapInArrow over (key, cls, text): (key, cls, items) of the rows whose text is of the class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, shingles, digest, seen, rows, total = None, None, 0, set(), [], 0
        for batch in batches:
            for key, cls, text in zip(*batch.columns):
                text = text.as_py()
                if shingles is None or text != last:
                    last, shingles = text, shingles_of(words_of(text), size)
                    digest = digest_of(shingles)
                pair = key.as_py(), cls.as_py()
                if digest == pair[1] and pair not in seen:  # copies of a class come once a task
                    seen.add(pair)
                    rows.append((*pair, shingles))
                    total += len(shingles)
                if total > HELD:  # memory
                    yield _set_rows(rows)
                    rows, total = [], 0
            if len(seen) > 1_000_000:  # memory
                seen.clear()
        if rows:
            yield _set_rows(rows)

    return run


def _set_rows(rows: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    ends = np.append(0, np.cumsum([len(r[2]) for r in rows]))
    items = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([r[2] for r in rows]).view(np.int64)))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), items], ["key", "cls", "items"])


def _bitmap(shingles: np.ndarray) -> bytes:
    """A bit or more for each shingle, each the parity of those that fall on it: XOR of two bitmaps is the bitmap of the difference."""
    bits = max(LEAST_BITS, 1 << max(0, len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """Bits that differ; the longer bitmap is folded to the length of the shorter, which keeps parities."""
    if len(a) < len(b):
        a, b = b, a
    x = int.from_bytes(a, "little")
    for half in (len(a) >> i for i in range(1, 64)):
        if half < len(b):
            break
        x = (x >> (8 * half)) ^ (x & ((1 << (8 * half)) - 1))
    return (x ^ int.from_bytes(b, "little")).bit_count()


def _bounded(percent: int):
    """For mapInArrow over (a, b, s, x, y): the pairs whose s shingles in all leave room for the bits that differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, x, y = (batch.column(i).to_pylist() for i in (2, 3, 4))
            ok = [differing(p, q) * (100 + percent) <= n * (100 - percent) for n, p, q in zip(s, x, y)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _items(docs: DataFrame, classes: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(key, cls, items) for wanted(key, cls), from the text of a row of each class."""
    wanted = saved(wanted.join(classes.select("cls", "mark"), "cls"))
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_MARKS else wanted
    texts = docs.join(wanted, "mark").select("key", "cls", "text")
    return texts.mapInArrow(_sets(size), "key long, cls long, items array<long>")


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar enough. Only pairs within the bounds fetch shingles."""
    p, q = (classes.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in "ab")
    sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    within = pairs.join(p, "a").join(q, "b").filter(sizes).select("a", "b", (F.col("n_a") + F.col("n_b")).alias("s"), "bits_a", "bits_b")
    within = saved(within.mapInArrow(_bounded(percent), "a long, b long"))
    left = _items(docs, classes, within.select(F.col("a").alias("key"), F.col("a").alias("cls")).distinct(), size)
    right = _items(docs, classes, within.select(F.col("a").alias("key"), F.col("b").alias("cls")), size)
    both = right.select("key", "cls", F.col("items").alias("y")).join(left.select("key", F.col("items").alias("x")), "key")
    shared = both.select(F.col("key").alias("a"), F.col("cls").alias("b"), F.size(F.array_intersect("x", "y")).alias("i"), (F.size("x") + F.size("y")).alias("s"))
    return saved(shared.filter(F.col("i") * 100 >= (F.col("s") - F.col("i")) * percent).select("a", "b").distinct())


def _labelled(df: DataFrame, labels: DataFrame) -> DataFrame:
    """df with the component of each class; a class without links is its own."""
    return df.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))


def _open(rows: DataFrame, key: str) -> DataFrame:
    """rows(key, cls, label ...) of keys that hold several components, with their number of rows. Keys are summed before they meet; both sides of the join are tables, so that Spark can split a hot key."""
    rows = saved(rows)
    several = rows.groupBy(key).agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("rows")).filter("low <> high")
    return saved(rows.join(saved(several.select(key, "rows")), key))


def _links(docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between classes: not all, but enough for the same components."""
    w = Window.partitionBy("key")
    rows = docs.select("text").mapInArrow(_signature_rows(size, percent), "key long, cls long, via array<long>")
    other = F.coalesce(F.size("via") > 0, F.lit(False))
    two = (F.count("*").over(w) == 2) & (F.count("via").over(w) == 0)  # its one pair is verified by its star: such a signature isn't looked at again
    met = rows.withColumns({"rep": F.min("cls").over(w), "last": F.max("cls").over(w), "two": two}).filter(other | ((F.col("rep") != F.col("last")) & ~(F.col("two") & (F.col("cls") == F.col("rep")))))
    met = saved(met.select(F.coalesce(F.get("via", F.lit(0)), "key").alias("sig"), "cls", F.coalesce(F.get("via", F.lit(1)), "rep").alias("rep"), "two"))

    star = met.filter("cls <> rep").select(F.col("rep").alias("a"), F.col("cls").alias("b")).distinct()
    first = _verified(docs, classes, star, size, percent)

    parts = _labelled(met.filter("NOT two").select("sig", "cls").distinct(), components(first))
    open_ = _open(parts, "sig")
    sizes = classes.select("cls", "n")
    few = saved(open_.filter(F.col("rows") <= CROWDED).join(sizes, "cls"))
    on = (F.col("p.sig") == F.col("q.sig")) & (F.col("p.cls") < F.col("q.cls")) & (F.col("p.label") != F.col("q.label"))
    pairs = few.alias("p").join(few.alias("q"), on & _like_sizes(percent)).select(F.col("p.cls").alias("a"), F.col("q.cls").alias("b"))

    crowd = saved(open_.filter(F.col("rows") > CROWDED).select(F.col("cls").alias("key"), "cls").distinct())
    if crowd.isEmpty():
        return first.union(_verified(docs, classes, pairs.distinct(), size, percent))
    items = saved(_items(docs, classes, crowd, size).dropDuplicates(["cls"]))
    rare = saved(_prefixes(items, percent).join(sizes, "cls"))
    least = saved(rare.groupBy("item").agg(F.min("cls").alias("a"), F.max("cls").alias("last")).filter("a <> last").select("item", "a"))
    stars = rare.join(least, "item").filter("cls <> a").select("a", F.col("cls").alias("b"))
    known = first.union(_verified(docs, classes, stars.distinct().join(star, ["a", "b"], "left_anti"), size, percent))
    pairs = pairs.union(_prefix_pairs(_open(_labelled(rare, components(known)), "item"), percent))
    return known.union(_verified(docs, classes, pairs.distinct(), size, percent))


def _like_sizes(percent: int):
    return F.least("p.n", "q.n") * 100 >= F.greatest("p.n", "q.n") * percent


def _prefixes(items: DataFrame, percent: int) -> DataFrame:
    """(cls, item, place) for the rarest n - ceil(p * n) + 1 shingles of each class that some other class has too."""
    each = items.select("cls", F.explode("items").alias("item"))
    ranked = each.join(each.groupBy("item").agg(F.count("*").alias("df")).filter("df > 1"), "item", "left")
    ordered = ranked.groupBy("cls").agg(F.sort_array(F.collect_set(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "item"))).alias("ordered"))
    length = F.size("ordered") - F.ceil(F.size("ordered") * percent / 100).cast("int") + 1
    rare = ordered.select("cls", F.posexplode(F.slice("ordered", F.lit(1), length)).alias("place", "x")).filter("x.df > 1")
    return rare.select("cls", "place", F.col("x.item").alias("item"))


def _prefix_pairs(rare: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes of different components that meet on a rare shingle and pass the bounds on sizes and on what can still be shared after a first common shingle."""
    on = (F.col("p.item") == F.col("q.item")) & (F.col("p.cls") < F.col("q.cls")) & (F.col("p.label") != F.col("q.label"))
    left = F.least(F.col("p.n") - F.col("p.place"), F.col("q.n") - F.col("q.place"))
    first = left * (100 + percent) >= (F.col("p.n") + F.col("q.n")) * percent
    return rare.alias("p").join(rare.alias("q"), on & first & _like_sizes(percent)).select(F.col("p.cls").alias("a"), F.col("q.cls").alias("b"))


def jaccard_members(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """For each row of docs(doc_id, mark, text): doc_id, mark, n and label, which linked rows share; a row without shingles has no label.

    mark is a hash of id and text: rows of one id, or of none, fetch their shingles each by their own."""
    members = saved(docs.mapInArrow(_members(size), "doc_id long, mark long, cls long, n long, bits binary"))
    classes = saved(members.filter("n > 0").groupBy("cls").agg(F.min("mark").alias("mark"), F.min("n").alias("n"), F.min("bits").alias("bits")))
    labels = _labelled(classes.select("cls"), components(_links(docs, classes, size, percent))).withColumn("filled", F.lit(True))
    own = members.select("doc_id", "mark", "cls", "n", (F.col("n") > 0).alias("filled"))
    return own.join(labels, ["cls", "filled"], "left").select("doc_id", "mark", "n", "label")


def jaccard_components(docs: DataFrame, size: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id that its links reach, itself included)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(id_col, text_col).alias("mark"), F.col(text_col).alias("text"))
    rows = saved(jaccard_members(docs, size, percent))
    smallest = saved(rows.filter("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("component_id")))
    out = rows.join(smallest, "label", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
