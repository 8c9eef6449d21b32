"""Removal of long repeated passages: every byte of a string of ``LENGTH`` bytes that starts anywhere else too.

Sorting every suffix of a corpus is too much to move, so suffixes that cannot matter are left out first. In every window of
``LENGTH`` bytes the least hash of its ``GRAM``-byte strings marks an anchor (the leftmost, if several). What a window
holds decides its anchor, so equal windows have equal anchors at the same place in them. Neighbouring windows with one anchor make a run, and
the bytes they cover are its context. Runs whose anchor string is nowhere else are done; so are those whose whole context is repeated.

What is left are the contexts that agree with others in part. Around each anchor they are sorted as suffixes, forward from the anchor
and backward from it, by deep-shallow sorting: multikey quicksort over 8-byte characters to a shallow depth, then a blind trie for each group of
suffixes that is still tied. A window that reaches d bytes back is repeated if some other context shares d bytes in
the backward order and ``LENGTH`` - d bytes in the forward order; both are runs of the sorted orders at that depth, so all contexts
are settled by one pass per depth and no pair of contexts is compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcal.llm.common import mix64, saved, slices, with_text_columns

LENGTH, GRAM = 200, 32
#: A window has so many places for its anchor, and reaches so far on either side of it.
PLACES = LENGTH - GRAM + 1
REACH = LENGTH - GRAM
WORDS = REACH // 8
#: 8-byte characters that multikey quicksort looks at before a blind trie takes over.
SHALLOW = 4
#: Contexts of one anchor string that are sorted at once; more are cut into tiles, and every pair of tiles is sorted.
TILE = 50_000
#: Contexts that a task holds, unless one anchor string has more.
HELD = 100_000

BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
FACTORS = {1: 0x9E3779B97F4A7C15, 2: 0xC2B2AE3D27D4EB4F, 4: 0x165667B19E3779F9, 8: 0xD6E8FEB86659FD93, 16: 0xA0761D6478BD642F}


def runs(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of one text: first window, number of windows, anchor place, hash of the anchor string."""
    if len(data) < LENGTH:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    h = BYTES[np.frombuffer(data, np.uint8)]
    for step, factor in FACTORS.items():  # strings of 2, 4, ... 32 bytes
        h = h[:-step] * np.uint64(factor) + h[step:]
    h = mix64(h)
    least, place, width = h, np.arange(len(h), dtype=np.int32), 1
    while width < PLACES:
        step = min(width, PLACES - width)
        right = least[step:] < least[:-step]
        least, place = np.where(right, least[step:], least[:-step]), np.where(right, place[step:], place[:-step])
        width += step
    first = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
    anchor = place[first].astype(np.int64)
    return first, np.diff(np.append(first, len(place))), anchor, h[anchor]


def anchored(docs: DataFrame) -> DataFrame:
    """(u, v, h, ctx, windows, back, firsts): the runs of each text; equal runs of a text are one row with several ``firsts``."""
    fields = "u bigint, v bigint, h bigint, ctx bigint, windows int, back int, firsts array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for start, texts in slices(batch.column(2)):
                row, h, ctx, windows, back, firsts = [], [], [], [], [], []
                for i, data in enumerate(texts):
                    first, count, anchor, hashed = runs(data or b"")
                    seen: dict[tuple[int, int], int] = {}
                    for p, n, a, x in zip(first.tolist(), count.tolist(), anchor.tolist(), hashed.view(np.int64).tolist(), strict=True):
                        key = (x, digest(data[p : p + n - 1 + LENGTH], a - p))
                        if (at := seen.get(key)) is not None:
                            firsts[at].append(p)
                            continue
                        seen[key] = len(h)
                        row.append(start + i)
                        h.append(x)
                        ctx.append(key[1])
                        windows.append(n)
                        back.append(a - p)
                        firsts.append([p])
                at = pa.array(row, pa.int64())
                columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(h, pa.int64()), pa.array(np.array(ctx, np.uint64).view(np.int64)), pa.array(windows, pa.int32()), pa.array(back, pa.int32()), pa.array(firsts, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in fields.split(", ")])

    return docs.mapInArrow(run, fields)


def blind_trie_order(strings: list[bytes]) -> list[int]:
    """Numbers of distinct strings of one length in sorted order.

    An inner node knows only the place of the first differing byte and a child per byte there. A string goes down without
    comparing until it meets a leaf; the first difference to that leaf is the only comparison, and says where it belongs.
    """
    size = len(strings[0])
    root: list | int = 0
    for number, s in enumerate(strings[1:], 1):
        node = root
        while not isinstance(node, int):
            node = node[1].get(s[node[0]]) if s[node[0]] in node[1] else next(iter(node[1].values()))
        other = strings[node]
        differ = size - (((int.from_bytes(s, "big") ^ int.from_bytes(other, "big")).bit_length() + 7) // 8)
        above, node = None, root
        while not isinstance(node, int) and node[0] < differ:
            above, node = node, node[1][s[node[0]]]
        if not isinstance(node, int) and node[0] == differ:
            node[1][s[differ]] = number
            continue
        new = [differ, {other[differ]: node, s[differ]: number}]
        if above is None:
            root = new
        else:
            above[1][s[above[0]]] = new
    order: list[int] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, int):
            order.append(node)
        else:
            stack += [node[1][c] for c in sorted(node[1], reverse=True)]
    return order


def deep_shallow(groups: np.ndarray, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort rows of ``strings`` (8-byte characters, first most significant) within ``groups``; (order, common bytes with the row before).

    Rows of different groups have -1 in common.
    """
    n, width = strings.shape
    order = np.lexsort((strings[:, 0], groups)) if n else np.zeros(0, np.int64)

    def ties(depth: int, old: np.ndarray) -> np.ndarray:
        """Whether each row is tied with the one before it."""
        same = np.zeros(n, bool)
        same[1:] = old[1:] & (strings[order[1:], depth] == strings[order[:-1], depth])
        return same

    tied = np.zeros(n, bool)
    if n:
        tied[1:] = groups[order[1:]] == groups[order[:-1]]
        tied = ties(0, tied)
    for depth in range(1, SHALLOW):
        part = np.cumsum(~tied)
        open_ = np.flatnonzero(tied | np.append(tied[1:], False))
        order[open_] = order[open_][np.lexsort((strings[order[open_], depth], part[open_]))]
        tied = ties(depth, tied)
    # Deep: equal rows stand together, and each group of several distinct ones is ordered by a blind trie.
    part = np.cumsum(~tied)
    open_ = np.flatnonzero(tied | np.append(tied[1:], False))
    if len(open_):
        rest = strings[order[open_]][:, SHALLOW:]
        mixed = np.zeros(len(open_), np.uint64)
        for column in rest.T:
            mixed = mix64(mixed * np.uint64(31) + column)
        at = np.lexsort((mixed, part[open_]))
        order[open_], rest = order[open_][at], rest[at]
        new = np.ones(len(open_), bool)
        new[1:] = (part[open_][1:] != part[open_][:-1]) | (rest[1:] != rest[:-1]).any(axis=1)
        heads = np.flatnonzero(new)  # a row for each distinct string, but for rows that a hash has parted
        sizes = np.diff(np.append(heads, len(open_)))
        starts = np.flatnonzero(np.diff(part[open_][heads], prepend=-1))
        raw = rest.astype(">u8").tobytes()
        wide = 8 * (width - SHALLOW)
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(heads)], strict=True):
            if b - a > 1:
                found: dict[bytes, list[int]] = {}
                for x in range(a, b):
                    found.setdefault(raw[heads[x] * wide : (heads[x] + 1) * wide], []).append(x)
                kinds = list(found)
                rows = [np.arange(heads[x], heads[x] + sizes[x]) for k in blind_trie_order(kinds) for x in found[kinds[k]]]
                begin, end = heads[a], heads[b - 1] + sizes[b - 1]
                order[open_[begin:end]] = order[open_[np.concatenate(rows)]]
    common = np.full(n, -1, np.int64)
    if n:
        differ = strings[order[1:]] ^ strings[order[:-1]]
        word = np.argmax(differ != 0, axis=1)
        value = np.take_along_axis(differ, word[:, None], axis=1)[:, 0]
        equal = np.where(value == 0, 8 * width, 8 * word + byte_zeros(value))
        common[1:] = np.where(groups[order[1:]] == groups[order[:-1]], equal, -1)
    return order, common


def byte_zeros(value: np.ndarray) -> np.ndarray:
    """Leading zero bytes of 64-bit numbers."""
    zeros = np.zeros(len(value), np.int64)
    for shift in (8, 16, 24, 32, 40, 48, 56):
        zeros += value < (np.uint64(1) << np.uint64(64 - shift))
    return zeros


def packed_rows(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(p[:REACH].ljust(REACH, b"\0") for p in parts), ">u8").astype(np.uint64).reshape(-1, WORDS)


def repeated_windows(groups: np.ndarray, contexts: list[bytes], windows: np.ndarray, back: np.ndarray) -> np.ndarray:
    """For each context and each reach d (0 to REACH) back from the anchor: is that window in another context of its group?"""
    n = len(contexts)
    forward = packed_rows([c[b + GRAM :] for c, b in zip(contexts, back.tolist(), strict=True)])
    behind = packed_rows([c[:b][::-1] for c, b in zip(contexts, back.tolist(), strict=True)])
    f_order, f_common = deep_shallow(groups, forward)
    b_order, b_common = deep_shallow(groups, behind)
    low = back - windows + 1
    out = np.zeros((n, REACH + 1), bool)
    f_class, b_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(REACH + 1):
        there = np.flatnonzero((low <= d) & (d <= back))
        if len(there) < 2:
            continue
        f_class[f_order] = np.cumsum(f_common < REACH - d)
        b_class[b_order] = np.cumsum(b_common < d)
        both = f_class[there] * (n + 1) + b_class[there]
        at = np.argsort(both, kind="stable")
        same = both[at][1:] == both[at][:-1]
        twice = np.append(same, False) | np.concatenate([[False], same])
        out[there[at[twice]], d] = True
    return out


def packed_texts(docs: DataFrame, keep: list[str], text: str = "text", name: str = "packed") -> DataFrame:
    """``keep`` and ``packed``, or another ``name``: whole texts, compressed, so that moving them costs a part of their size."""

    def make():
        press = zstandard.ZstdCompressor(level=3)
        return lambda texts: [[press.compress(t or b"") for t in texts]]

    return with_text_columns(docs, make, f"`{name}` binary", text, keep)


def repeats(keyed: DataFrame) -> DataFrame:
    """(u, v, start, end): intervals of bytes that repeated windows cover. ``keyed`` has u, v and text."""
    found = saved(anchored(keyed.select("u", "v", "text")), "anchors")
    # Anchor strings that occur more than once, and whether in more than one context.
    kinds = found.groupBy("h").agg(F.sum(F.size("firsts")).alias("n"), (F.min("ctx") != F.max("ctx")).alias("several")).where("n > 1")
    rows = saved(found.join(kinds, "h").drop("n"), "repeated-anchors")
    partly = rows.where("several")
    least = F.min(F.struct("u", "v", "windows", "back", F.col("firsts")[0].alias("first"))).alias("m")
    contexts = saved(partly.groupBy("h", "ctx").agg(F.sum(F.size("firsts")).alias("n"), least), "contexts")
    whole = rows.where("not several").select("u", "v", "windows", "firsts").unionByName(
        partly.join(contexts.where("n > 1").select("h", "ctx"), ["h", "ctx"]).select("u", "v", "windows", "firsts")
    )
    covered = whole.select("u", "v", "windows", F.explode("firsts").alias("start")).select("u", "v", "start", F.expr(f"start + windows - 1 + {LENGTH}").alias("end"))

    hot = contexts.groupBy("h").count().where(F.col("count") > TILE)
    tiles = F.ceil(F.coalesce("count", F.lit(1)) / TILE).cast("int")
    dealt = (
        contexts.join(hot, "h", "left").withColumn("tiles", tiles)
        .withColumn("own", F.pmod("ctx", F.col("tiles")).cast("int"))
        .select("h", "n", "m", F.expr("transform(sequence(0, tiles - 1), o -> struct(least(own, o) as i, greatest(own, o) as j))").alias("at"))
    )
    asked = dealt.groupBy(F.col("m.u").alias("u"), F.col("m.v").alias("v")).agg(F.collect_list(F.struct("h", F.col("n") == 1, "at", "m.windows", "m.back", "m.first")).alias("asked"))
    joined = packed_texts(keyed, ["u", "v"]).join(asked, ["u", "v"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        names = ["h", "i", "j", "u", "v", "alone", "windows", "back", "first", "context"]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                out = []
                for u, v, data, wanted in zip(*(c.to_pylist() for c in batch.slice(at, 500).columns), strict=True):
                    text = unpack.decompress(data)
                    for w in wanted:
                        h, alone, places, windows, back, first = w.values()
                        out += [(h, p["i"], p["j"], u, v, alone, windows, back, first, text[first : first + windows - 1 + LENGTH]) for p in places]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)

    parts = joined.mapInArrow(cut, "h bigint, i int, j int, u bigint, v bigint, alone boolean, windows int, back int, first int, context binary")
    placed = parts.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(table: pa.Table) -> pa.RecordBatch:
            column = [table.column(k).to_numpy() for k in range(9)]
            new = np.concatenate([[False], (column[0][1:] != column[0][:-1]) | (column[1][1:] != column[1][:-1]) | (column[2][1:] != column[2][:-1])])
            windows, back, first = (column[k].astype(np.int64) for k in (6, 7, 8))
            marked = repeated_windows(np.cumsum(new), table.column(9).to_pylist(), windows, back)
            marked &= column[5][:, None].astype(bool)
            edge = np.diff(np.pad(marked, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            row, low = np.nonzero(edge == 1)
            high = np.nonzero(edge == -1)[1] - 1
            # A window that reaches d back starts at first + back - d.
            start, end = first[row] + back[row] - high, first[row] + back[row] - low + LENGTH
            return pa.RecordBatch.from_arrays([pa.array(column[3][row]), pa.array(column[4][row]), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], names=["u", "v", "start", "end"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) > HELD:
                table = pa.Table.from_batches(held)
                keys = np.column_stack([table.column(k).to_numpy() for k in range(3)])
                other = (keys != keys[-1]).any(axis=1)
                if other.any():
                    cut_at = len(keys) - int(np.argmax(other[::-1]))
                    yield flush(table.slice(0, cut_at))
                    held = table.slice(cut_at).combine_chunks().to_batches()
        if held:
            yield flush(pa.Table.from_batches(held))

    return covered.unionByName(placed.mapInArrow(settle, "u bigint, v bigint, start int, end int"))


def without_repeats(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all but the text), with ``n_bytes``, ``n_removed``, ``spans`` (start and end of each maximal removed run) and ``kept``, the bytes that stay.

    Null texts are empty ones; texts shorter than LENGTH stay as they are. Rows that are equal repeat each other, so from
    LENGTH bytes on they lose all. Columns that bear the names of new ones are replaced. An empty table gives no rows.
    """
    new = ("n_bytes", "n_removed", "spans", "kept")
    stay = [c for c in (docs.columns if keep is None else keep) if c != text and c not in new]
    # Helper columns bear names that no column has; the others keep theirs, as Spark reasons about renamed ones.
    u, v, packed, found = (name + "_" * (1 + max(map(len, docs.columns))) for name in ("u", "v", "packed", "found"))
    others = [F.col(f"`{c}`") for c in stay]
    keyed = docs.select(*others, F.col(text).alias(packed), F.xxhash64(*others, F.col(text)).alias(u), F.xxhash64(F.lit(1), F.col(text), *others).alias(v))
    spans = repeats(keyed.select(F.col(u).alias("u"), F.col(v).alias("v"), F.col(packed).alias("text"))).groupBy("u", "v").agg(F.collect_list(F.struct("start", "end")).alias(found))
    whole = packed_texts(keyed, [*stay, u, v], packed, packed)
    joined = whole.join(spans.withColumnsRenamed({"u": u, "v": v}), [u, v], "left").select(*others, packed, found)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    schema = StructType([*[docs.schema[c] for c in stay], *_parse_datatype_string("n_bytes bigint, n_removed bigint, spans array<struct<start: int, end: int>>, kept binary").fields])
    arrow = to_arrow_schema(schema)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out: list[tuple] = []
                for data, found in zip(part.column(len(stay)).to_pylist(), part.column(len(stay) + 1).to_pylist(), strict=True):
                    raw = unpack.decompress(data)
                    merged: list[list[int]] = []
                    for start, end in sorted((f["start"], f["end"]) for f in found or []):
                        if merged and start <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], end)
                        else:
                            merged.append([start, end])
                    kept, last = [], 0
                    for start, end in merged:
                        kept.append(raw[last:start])
                        last = end
                    kept.append(raw[last:])
                    out.append((len(raw), sum(e - s for s, e in merged), [{"start": s, "end": e} for s, e in merged], b"".join(kept)))
                old = [part.column(i).cast(t) for i, t in zip(range(len(stay)), arrow.types, strict=False)]
                yield pa.RecordBatch.from_arrays(old + [pa.array([r[k] for r in out], arrow.types[len(stay) + k]) for k in range(4)], schema=arrow)

    return joined.mapInArrow(remove, schema)

