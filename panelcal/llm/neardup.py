"""Near-duplicate classes by SimHash, found with a Gray-order hierarchical index.

Fingerprints that differ in at most ``radius`` bits are linked; a class is what links connect.
Equal fingerprints collapse first. Each distinct fingerprint then goes to cells: the 64 bits are cut
into ``blocks`` blocks, and as at most ``radius`` of them can differ, two linked fingerprints agree
on the bits of at least one choice of ``blocks - radius`` blocks. In a cell the fingerprints are
sorted by Gray rank and factored into a tree: an upper node keeps the bits that all its members
share (pattern and mask). The self-search walks pairs of nodes from the top; the differences of
the shared bits are a lower bound for all pairs below, so whole groups are pruned by it, and groups
that are already one class, or can only be linked, are settled without being opened.
A cell returns links that span its classes, so that n close copies give n links and not n squared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from panelcal.llm.common import Texts, WordTable, aside, components, few, mix64, restored, saved, with_text_columns
from panelcal.llm.simhash import fingerprint, signed, vote

RADIUS = 4
BLOCKS = 6
#: Children of a node of the index.
FANOUT = 8
#: Members of a cell that are searched at once; larger cells are cut into tiles, and every pair of tiles is searched.
TILE = 1 << 16
#: Pairs of nodes looked at in one vector step.
STEP = 1 << 19
#: Least shingle hashes of a text's sketch, and how many of them a similar text shares at least.
SKETCH, SHARED = 32, 9


def with_fingerprints(docs: DataFrame, words: int = 4, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``fp``, the 64-bit fingerprint as a long. Null and wordless texts have 0."""

    def make():
        def run(texts: Texts) -> list:
            return [np.array([signed(fingerprint(t, words)) for t in texts], np.int64)]

        return run

    return with_text_columns(docs, make, "fp bigint", text, keep)


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Position of each 64-bit value in the reflected Gray sequence."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class Forest:
    """Disjoint sets over 0 .. n-1; the root of a set is its smallest member."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)
        none = np.zeros(0, np.int64)
        self.used = [(none, none)]

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        """Join the sets of i and j pairwise; ``used`` gets the pairs that joined two sets."""
        while len(i):
            a, b = self.root[i], self.root[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            high, low = np.maximum(a, b), np.minimum(a, b)
            np.minimum.at(self.root, high, low)
            won = np.flatnonzero(self.root[high] == low)
            won = won[np.unique(high[won], return_index=True)[1]]
            self.used.append((i[won], j[won]))
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up


def cell_links(cells: np.ndarray, values: np.ndarray, radius: int, classes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of values within ``radius`` bits that connect all such pairs of a cell: one less than members, for each class.

    With given ``classes``, every pair within ``radius`` bits whose classes differ.
    """
    order = np.lexsort((gray_rank(values), cells))
    cells, f = cells[order], values[order]
    n = len(f)
    forest = Forest(n)
    if classes is not None:
        forest.root = np.unique(classes[order], return_inverse=True)[1]
    else:
        near = (cells[1:] == cells[:-1]) & (np.bitwise_count(f[1:] ^ f[:-1]) <= radius)
        i = np.flatnonzero(near)
        forest.link(i, i + 1)
    # Levels from the leaves up: pattern, shared bits, cell, first child.
    pattern, mask, cell = [f], [np.full(n, ~np.uint64(0))], [cells]
    first: list[np.ndarray] = [np.arange(n + 1)]
    while len(cell[-1]) > len(np.unique(cell[-1])):
        c = cell[-1]
        begins = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        place = np.arange(len(c)) - np.repeat(begins, np.diff(np.concatenate([begins, [len(c)]])))
        starts = np.flatnonzero(place % FANOUT == 0)
        low, high = np.bitwise_and.reduceat(pattern[-1], starts), np.bitwise_or.reduceat(pattern[-1] | ~mask[-1], starts)
        shared = np.bitwise_and.reduceat(mask[-1], starts) & ~(low ^ high)
        pattern.append(low & shared)
        mask.append(shared)
        cell.append(c[starts])
        first.append(np.concatenate([starts, [len(c)]]))
    leaf = [np.arange(n + 1)]  # first leaf below each node
    for starts in first[1:]:
        leaf.append(leaf[-1][starts])

    def one_class(level: int) -> np.ndarray:
        """Class of all leaves below each node, or -1 if they are of several."""
        at = leaf[level][:-1]
        low, high = np.minimum.reduceat(forest.root, at), np.maximum.reduceat(forest.root, at)
        return np.where(low == high, low, -1)

    top = len(cell) - 1
    nodes = np.arange(len(cell[top]))
    stack = [(top, nodes, nodes)]
    while stack:
        level, a, b = stack.pop()
        if len(a) > STEP:
            stack.append((level, a[STEP:], b[STEP:]))
            a, b = a[:STEP], b[:STEP]
        whole = one_class(level)
        both = mask[level][a] & mask[level][b]
        apart = np.bitwise_count((pattern[level][a] ^ pattern[level][b]) & both)
        open_ = (apart <= radius) & ~((whole[a] == whole[b]) & (whole[a] >= 0))
        a, b, both, apart = a[open_], b[open_], both[open_], apart[open_]
        if classes is not None and not level:
            forest.used.append((a, b))
            continue
        sure = np.bitwise_count(~both) + apart <= radius  # every pair below is linked
        if classes is None and sure.any():
            for x, y in ((a[sure], b[sure]), (a[sure], a[sure]), (b[sure], b[sure])):
                size = leaf[level][x + 1] - leaf[level][x]
                start = np.repeat(leaf[level][x], size)
                inner = start + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                forest.link(inner, np.repeat(leaf[level][y], size))
            a, b = a[~sure], b[~sure]
        if level and len(a):
            left, right = first[level][a + 1] - first[level][a], first[level][b + 1] - first[level][b]
            count = left * right
            pair = np.repeat(np.arange(len(a)), count)
            k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            x, y = first[level][a][pair] + k // right[pair], first[level][b][pair] + k % right[pair]
            keep = x <= y
            stack.append((level - 1, x[keep], y[keep]))
    i, j = (np.concatenate(x) for x in zip(*forest.used, strict=True))
    return f[i], f[j]


def in_cells(fingerprints: DataFrame, radius: int, blocks: int) -> DataFrame:
    """(table, key, fp, class): each fingerprint once per choice of ``blocks - radius`` of its blocks."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [sum(((1 << (cuts[b + 1] - cuts[b])) - 1) << cuts[b] for b in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(masks)])
    return fingerprints.select("fp", "class", F.explode(keys).alias("c")).select("c.t", "c.key", "fp", "class")


def links(fingerprints: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints within ``radius`` bits that connect all such pairs.

    If there is a column ``class`` (long): all pairs within ``radius`` bits of different classes, some repeatedly.
    """
    blocks = blocks or radius + 2
    given = "class" in fingerprints.columns
    spread = in_cells(fingerprints if given else fingerprints.withColumn("class", F.lit(0).cast("long")), radius, blocks)
    # Cells beyond a tile; at most (members / TILE) of them, so that Spark may broadcast them if small.
    hot = saved(spread.groupBy("t", "key").count().where(F.col("count") > TILE), "hot-cells")
    tiles = F.ceil(F.coalesce("count", F.lit(1)) / TILE).cast("int")
    dealt = (
        spread.join(hot, ["t", "key"], "left")
        .withColumn("tiles", tiles)
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "class")
    )
    placed = dealt.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[np.ndarray]) -> pa.RecordBatch:
            rows = np.concatenate(held)
            new = np.concatenate([[False], (rows[1:, :4] != rows[:-1, :4]).any(axis=1)])
            cells = np.cumsum(new)
            several = np.bincount(cells)[cells] > 1
            rows, cells = rows[several], cells[several]
            a, b = cell_links(cells, rows[:, 4].copy().view(np.uint64), radius, rows[:, 5] if given else None) if len(rows) else (np.zeros(0, np.uint64),) * 2
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        held: list[np.ndarray] = []
        for batch in batches:
            rows = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(6)])
            held.append(rows)
            if sum(map(len, held)) > 4 * TILE:  # up to the last cell that is surely complete
                rows = np.concatenate(held)
                cut = len(rows) - 1 - np.argmax((rows[::-1, :4] != rows[-1, :4]).any(axis=1))
                if (rows[cut, :4] != rows[-1, :4]).any():
                    yield flush([rows[: cut + 1]])
                    held = [rows[cut + 1 :]]
        if held:
            yield flush(held)

    return placed.mapInArrow(search, "a bigint, b bigint")


def near_classes(fingerprinted: DataFrame, radius: int = RADIUS, blocks: int | None = None, id_col: str = "doc_id") -> DataFrame:
    """(fp, component_id): the smallest id of all rows whose fingerprints links connect with fp.

    Null ids count only where a class has no other: its component_id is then null. An empty table
    gives no rows.
    """
    least = saved(fingerprinted.groupBy("fp").agg(F.min(id_col).alias("least")), "fingerprints")
    roots = components(links(least.select("fp"), radius, blocks), "a", "b")
    joined = least.join(roots, least.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    lowest = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return joined.join(lowest, "root").select("fp", "component_id")


def with_components(docs: DataFrame, words: int = 4, radius: int = RADIUS, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, fingerprint, component_id) of every row, repeated rows included.

    The fingerprint is 16 hex digits; rows of equal fingerprints share a class, so a hot fingerprint
    (a third of all rows, say) is one node of the search and a skewed, splittable join here.
    """
    prints = saved(with_fingerprints(docs, words, text, [id_col]), "doc-fingerprints")
    classes = near_classes(prints, radius, id_col=id_col)
    return prints.join(classes, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


class Shingler:
    """Shingles of whole texts as 64-bit hashes; each different word of a task is hashed once."""

    def __init__(self, words: int) -> None:
        self.words = words
        self.known = WordTable(lambda new: [np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new))])
        self.factors = mix64(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)

    def hashes(self, texts: Texts) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Word hashes of each text in order, and its distinct shingles, sorted.

        A-Z are in lower case, words lie between blanks; fewer words than a shingle has make one of them all,
        and no word makes none.
        """
        split = [(t or b"").lower().split() for t in texts]
        at = self.known.lookup([w for found in split for w in found])
        flat = self.known.arrays[0][at] if len(at) else np.zeros(0, np.uint64)
        rolled = np.zeros(max(0, len(flat) - self.words + 1), np.uint64)
        for i, factor in enumerate(self.factors):
            rolled += flat[i : i + len(rolled)] * factor
        rolled = mix64(rolled)
        ends = np.cumsum([0, *map(len, split)])
        each, sets = [], []
        for start, end in zip(ends[:-1], ends[1:], strict=True):
            own = flat[start:end]
            each.append(own)
            if len(own) >= self.words:
                sets.append(np.unique(rolled[start : end - self.words + 1]))
            else:
                sets.append(mix64(np.array([len(own)], np.uint64) + (own * self.factors[: len(own)]).sum(dtype=np.uint64))[: len(own)])
        return each, sets


def lists(values: list[np.ndarray]) -> pa.Array:
    """Arrays of 64-bit hashes as one Arrow list column of longs."""
    ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*values, np.zeros(0, np.uint64)]).view(np.int64)))


def with_sketches(rows: DataFrame, words: int, text: str, keep: list[str]) -> DataFrame:
    """``n``, the number of distinct shingles of a text, and ``sketch``, the ``SKETCH`` least of their hashes."""

    def make():
        shingler = Shingler(words)

        def run(texts: Texts) -> list:
            sets = shingler.hashes(texts)[1]
            return [list(map(len, sets)), lists([s[:SKETCH] for s in sets])]

        return run

    return with_text_columns(rows, make, "n int, sketch array<bigint>", text, keep)


def with_shingle_sets(rows: DataFrame, words: int, text: str, keep: list[str]) -> DataFrame:
    """``fp``, the fingerprint over a text's distinct words (an edit of a few in a hundred moves few bits), ``n`` and ``items``, its distinct shingles."""

    def make():
        shingler = Shingler(words)

        def run(texts: Texts) -> list:
            each, sets = shingler.hashes(texts)
            prints = [signed(vote(np.unique(h))) if len(h) else 0 for h in each]
            return [np.array(prints, np.int64), list(map(len, sets)), lists(sets)]

        return run

    return with_text_columns(rows, make, "fp bigint, n int, items array<bigint>", text, keep)


def similarity(a: str, b: str) -> Column:
    """Share of common shingles of two sets of distinct ones; 1 for two empty ones."""

    @pandas_udf("double")
    def jaccard(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for u, v in zip(x, y, strict=True):
            both = len(np.intersect1d(u, v, assume_unique=True))
            out.append(both / max(1, len(u) + len(v) - both) if len(u) or len(v) else 1.0)
        return pd.Series(out, dtype=float)

    return jaccard(a, b)


def with_partners(nodes: DataFrame, least: float) -> DataFrame:
    """(key, low) of the texts whose sketch has enough items that sketches of other texts have too.

    Of the ``SKETCH`` least shingles of two texts together a share of ``least`` is common on average, and all of these are in both sketches;
    fewer than ``SHARED`` are so for one similar pair in 10^10. A text of fewer shingles is judged by all of them, exactly.
    """
    each = nodes.select("key", F.explode("sketch").alias("item"))
    shared = each.groupBy("item").agg(F.count("*").alias("met")).where("met > 1").select("item")
    held = each.join(shared, "item").groupBy("key").agg(F.count("*").alias("held"))
    need = F.least(F.lit(SHARED), F.ceil(F.col("n") * least - 1e-9))
    return nodes.select("key", "low", "n").join(held, "key").where(F.col("held") >= need).select("key", "low")


def prefixes(sets: DataFrame, least: float) -> DataFrame:
    """(item, key, n, at, own): shingles such that any two of these sets with a similarity of ``least`` or more share one.

    Of the n shingles of a set, rarest first, the first n - ceil(least n) + 1, with their place in that order. Those of one set alone,
    a share ``own`` of it, are rarest and left out. So a text that differs enough from all others has none, and a common line
    is met only in texts that are little else.
    """
    each = sets.select("key", "n", F.explode("items").alias("item"))
    shared = each.groupBy("item").agg(F.count("*").alias("met")).where("met > 1")
    some = each.join(shared, "item").groupBy("key", "n").agg(F.array_sort(F.collect_list(F.struct("met", "item"))).alias("met"))
    alone = F.col("n") - F.size("met")
    length = (F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1 - alone).cast("int")
    first = some.withColumn("alone", alone).withColumn("length", length).where("length > 0")
    placed = first.select("key", "n", "alone", F.posexplode(F.slice("met", 1, F.col("length"))).alias("p", "m"))
    return placed.select("m.item", "key", "n", (F.col("p") + F.col("alone")).alias("at"), (F.col("alone") / F.col("n")).alias("own"))


def may_link(least: float, n: str = "n", m: str = "m", i: str = "i", j: str = "j") -> Column:
    """Whether sets of n and m shingles that first share one at the places i and j can reach a similarity of ``least``."""
    size = F.least(n, m) >= F.greatest(n, m) * least - 1e-9
    left = F.least(F.col(n) - F.col(i), F.col(m) - F.col(j))
    return size & (left >= (F.col(n) + F.col(m)) * (least / (1 + least)) - 1e-9)


def star_pairs(index: DataFrame, least: float) -> DataFrame:
    """Of each item, its texts with the one that has the least of its own: a base with its edited copies, say."""
    hub = index.groupBy("item").agg(F.min(F.struct("own", "key", "n", "at")).alias("h"))
    met = index.join(hub, "item").select("key", "n", F.col("at").alias("i"), F.col("h.key").alias("y"), F.col("h.n").alias("m"), F.col("h.at").alias("j"))
    return met.where((F.col("key") != F.col("y")) & may_link(least)).select(F.col("key").alias("x"), "y")


def crossing_pairs(index: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Pairs of texts of different classes that share an item and can be similar.

    A pair can only be so if their sizes are of the same or a neighbouring band, so items meet within bands.
    """
    band = F.floor(F.log("n") / F.lit(math.log(1 / least)) + 1e-9)
    each = index.join(classes, "key").withColumn("band", band)
    split = each.groupBy("item").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low != high").select("item")
    mixed = saved(each.join(split, "item"), "mixed-items")
    left = mixed.select("item", "band", F.col("key").alias("x"), F.col("class").alias("c"), "n", F.col("at").alias("i"))
    right = mixed.select("item", F.explode(F.array(*[F.col("band") + d for d in (-1, 0, 1)])).alias("band"), F.col("key").alias("y"), F.col("class").alias("d"), F.col("n").alias("m"), F.col("at").alias("j"))
    return left.join(right, ["item", "band"]).where((F.col("c") < F.col("d")) & may_link(least)).select("x", "y")


def one_per_class(docs: DataFrame, words: int = 5, least: float = 0.8, radius: int = 6, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` less near copies: one row of each class of similar texts stays, that of the smallest id.

    Two texts are linked if their sets of ``words``-word shingles, over whole texts, have a similarity of ``least`` or more, whatever
    their length; a class is what links and equal texts connect. Null and wordless texts are equal texts. Of rows equal in id
    and text one stays; rows of null id stay only where their class has no other. Columns are those of ``docs``,
    whatever their names; an empty table gives no rows.

    Texts without a partner by their sketches are done. Of the others, the Gray-order index gives pairs that span the groups of
    fingerprints within ``radius`` bits, and an index of rare shingles the pairs of each item with its hub; these are verified
    and make classes. What the index of rare shingles then still has across two classes is verified too, which loses no link.
    """
    blank = F.coalesce(F.col(text), F.lit(""))
    key = F.when(F.trim(F.translate(blank, "\t\n\x0b\x0c\r", "     ")) == "", F.lit(0)).otherwise(F.xxhash64(blank))
    rows = docs.select(*aside(docs), F.col(id_col).alias("id"), key.alias("key"))
    body = docs.select(F.col(id_col).alias("id"), key.alias("key"), F.col(text).alias("body"))
    prints = with_sketches(body, words, "body", ["id", "key"])
    nodes = saved(prints.groupBy("key").agg(F.min("id").alias("low"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "texts")
    partners = few(saved(with_partners(nodes, least), "partners"))
    wanted = body.join(partners, "key").where(F.col("id").eqNullSafe(F.col("low")))
    sets = saved(with_shingle_sets(wanted, words, "body", ["key"]), "shingle-sets")
    if sets.count() > partners.count():  # rows that repeat in id and text
        sets = saved(sets.dropDuplicates(["key"]), "shingle-sets")
    # Each fingerprint stands for its smallest text; its other texts are candidates with that one.
    heads = saved(sets.groupBy("fp").agg(F.min("key").alias("head")), "heads")
    near = links(heads.select("fp"), radius, radius + 2)
    across = near.join(heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b").select("x", "y")
    same = sets.select("key", "fp").join(heads, "fp").where("key != head").select(F.col("key").alias("x"), F.col("head").alias("y"))
    index = saved(prefixes(sets.select("key", "n", "items"), least), "rare-shingles")
    first = saved(verified(ordered(across.unionByName(same).unionByName(star_pairs(index, least))), sets, least), "first-links")
    roots = components(first, "x", "y")
    classes = sets.select("key").join(roots, F.col("key") == F.col("node"), "left").select("key", F.coalesce("root", "key").alias("class"))
    rest = verified(ordered(crossing_pairs(index, saved(classes, "classes"), least)), sets, least)
    roots = components(first.unionByName(rest), "x", "y")
    rooted = nodes.join(roots, F.col("key") == F.col("node"), "left").select("key", F.coalesce("root", "key").alias("root"), "low")
    stays = rooted.groupBy("root").agg(F.min_by("key", F.struct(F.col("low").isNull(), "low", "key")).alias("key"), F.min("low").alias("low"))
    gone = few(saved(rooted.join(stays.select("key").withColumn("stays", F.lit(True)), "key", "left").where("stays is null").select("key"), "gone-texts"))
    return first_rows(rows.join(gone, "key", "left_anti"), nodes).select(*restored(docs))


def first_rows(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of the rows of each text one of its smallest id, ``low`` in ``nodes``; texts of one row alone are not shuffled while the others are few."""
    several = few(saved(nodes.where("copies > 1").select("key", "low"), "copied-texts"))
    once = rows.join(several.select("key"), "key", "left_anti")
    of = rows.join(several, "key").where(F.col("id").eqNullSafe(F.col("low"))).dropDuplicates(["key"])
    return once.unionByName(of.select(*once.columns))


def ordered(pairs: DataFrame) -> DataFrame:
    """Each pair (x, y) once, the smaller first."""
    return pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs whose sets have a similarity of ``least`` or more; those whose sizes rule it out are not compared."""
    size = lambda end, name: sets.select(F.col("key").alias(end), F.col("n").alias(name))
    fit = pairs.join(size("x", "k"), "x").join(size("y", "m"), "y").where(F.least("k", "m") >= F.greatest("k", "m") * least - 1e-9).select("x", "y")
    met = fit.join(sets.select(F.col("key").alias("x"), F.col("items").alias("p")), "x").join(sets.select(F.col("key").alias("y"), F.col("items").alias("q")), "y")
    return met.where(similarity("p", "q") >= least).select("x", "y")
