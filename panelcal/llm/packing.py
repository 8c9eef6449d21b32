"""Packing token sequences: dominance reduction, then best fit.

Only the length of a piece matters to packing, and lengths are at most ``capacity``. So the plan is made
on the histogram of lengths (at most ``capacity`` numbers, whatever the corpus size): bins of equal
content are one pattern with a count. Pieces are then dealt to the places of their length by rank, in
parallel.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from panelcal.llm.common import RECALL, cuts, number_rows, saved, short_batches, trim

CAPACITY = 4096
END_ID = 1
#: Characters whose lower case may depend on the library or the neighbours, and the start of a special token: such texts are not folded here.
UNFOLDED = r"[^\x00-\x{12f}\x{131}-\x{24f}]|<\|"
#: Words that the normalizer leaves as they are and the splitter as one: lower-case Latin letters, none of which is changed or joined by NFC.
PLAIN = f"^[{''.join(c for c in map(chr, range(0x250)) if c.isalpha() and c == c.lower())}]+$"
#: Letters that stay letters when normalized, so that marks behind them are apart; İ, for one, becomes i and a mark that joins them.
ENDS_IN_LETTER = r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}]$"
#: Marks that end a run without joining its last word.
MARKS = ",.!?;:*&$%#|()\"-"
KNOWN_CHUNKS = 500_000
#: Texts are tokenized so many bytes at a time. Over 53 MB of texts a worker took 319 MB at most, with whole batches 345.
CUT_BYTES = 1_000_000
#: A special token of the vocabulary and its id, used as a separator.
MARK = ("<|endoftext|>", 49407)


@dataclass(frozen=True)
class Pattern:
    """``count`` bins that each hold ``items``: (length, how many), in the order of their offsets."""

    items: tuple[tuple[int, int], ...]
    count: int


def reduce_dominated(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Martello and Toth's reduction: fix small sets that dominate every other bin with the same longest piece.

    For the longest piece that is left, let k be how many of the shortest others fit beside it.
    k = 0: it fills a bin alone. An exact partner exists: the two. k = 1: it and the longest that fits.
    k = 2: it and the longest that fits, if no two others that fit together are longer. In each case some
    optimal packing has that bin, so the rest is a smaller instance of the same problem. A piece for which
    none of these holds is passed over. Changes ``counts``.
    """
    fixed: list[Pattern] = []
    lengths = sorted(n for n, c in counts.items() if c)

    def take(items: dict[int, int], times: int) -> None:
        fixed.append(Pattern(tuple(sorted(items.items(), reverse=True)), times))
        for n, q in items.items():
            counts[n] -= q * times
            if not counts[n]:
                lengths.pop(bisect_left(lengths, n))

    def smallest(w: int, most: int) -> list[int]:
        found: list[int] = []
        for n in lengths:
            found += [n] * min(most - len(found), counts[n] - (n == w))
            if len(found) == most:
                break
        return found

    changed = True
    while changed:
        changed = False
        for w in sorted(lengths, reverse=True):
            while counts[w]:
                room = capacity - w
                low = smallest(w, 3)
                if not low or low[0] > room:
                    take({w: 1}, counts[w])
                    changed = True
                    continue
                if room in counts and counts[room] - (room == w) > 0:
                    if room == w:
                        take({w: 2}, counts[w] // 2)
                    else:
                        take({w: 1, room: 1}, min(counts[w], counts[room]))
                    changed = True
                    continue
                at = bisect_left(lengths, room + 1) - 1
                if counts[lengths[at]] - (lengths[at] == w) <= 0:
                    at -= 1
                best = lengths[at]
                fits = len(low) if sum(low) <= room else 2 if sum(low[:2]) <= room else 1
                if len(low) == 1 or fits == 1 or fits == 2 and best >= best_pair(lengths, counts, w, room):
                    # What fits only shrinks as pieces go, so the same holds for all copies.
                    take({w: 2} if best == w else {w: 1, best: 1}, counts[w] // 2 if best == w else min(counts[w], counts[best]))
                    changed = True
                    continue
                break
    return fixed


def best_pair(lengths: list[int], counts: dict[int, int], w: int, room: int) -> int:
    """The largest sum of two other pieces that fit beside w."""
    there = [n for n in lengths if counts[n] - (n == w) > 0]
    best = 0
    for n in there:
        at = bisect_left(there, room - n + 1) - 1
        if at >= 0 and there[at] == n and counts[n] - (n == w) < 2:
            at -= 1
        if at >= 0:
            best = max(best, n + there[at])
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing on a histogram: each piece, longest first, goes to the fullest bin that still takes it.

    Bins of equal content are one entry. As pieces of a length come one after the other, the fullest bin that takes one
    takes as many as fit before the next is touched, so whole entries are filled at once.
    """
    open_: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    rooms: list[int] = []

    def put(room: int, items: tuple[tuple[int, int], ...], count: int) -> None:
        if count:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append((items, count))

    for n in sorted((n for n, c in counts.items() if c), reverse=True):
        left = counts[n]
        filled: list[tuple[int, tuple[tuple[int, int], ...], int]] = []
        while left and (at := bisect_left(rooms, n)) < len(rooms):
            room = rooms[at]
            items, count = open_[room].pop()
            if not open_[room]:
                del open_[room], rooms[at]
            each = room // n
            whole = min(count, left // each)
            left -= whole * each
            filled.append((room - each * n, (*items, (n, each)), whole))
            if whole < count and left:  # a last bin takes what is left
                filled.append((room - left * n, (*items, (n, left)), 1))
                whole, left = whole + 1, 0
            put(room, items, count - whole)
        if left:
            each = capacity // n
            put(capacity - each * n, ((n, each),), left // each)
            if left % each:
                put(capacity - left % each * n, ((n, left % each),), 1)
        for room, items, count in filled:
            put(room, items, count)
    return [Pattern(items, count) for entries in open_.values() for items, count in entries]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that hold every counted piece once: reduction, then best fit for what it leaves."""
    if any(not 0 < n <= capacity for n in counts):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    rest = dict(counts)
    fixed = reduce_dominated(rest, capacity)
    return fixed + best_fit(rest, capacity)


def byte_letters() -> dict[int, int]:
    """The code point that stands for each byte in a byte-level vocabulary: itself if printable, else 256 on in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + i for i, b in enumerate(others)}


def token_bytes(tokenizer_path: str):
    """A function from texts, a list or an Arrow array (null: empty), to their ids as little-endian 32-bit words.

    Tokens never reach over white space, so the ids of a text are those of its runs of other characters. Arrow splits the
    texts and numbers the distinct runs; each of these is tokenized once per worker while it is remembered. Runs end at ASCII white
    space only; other white space stays in its run, for the library to split.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    mark, mark_id = MARK
    if tokenizer.token_to_id(mark) != mark_id:
        raise ValueError(f"the vocabulary lacks {mark} as {mark_id}")
    known = RECALL.setdefault(tokenizer_path, ({},))[0]  # ids of runs, and of the words and marks they are made of
    model = tokenizer.model
    letters = byte_letters()

    def objects(column: pa.Array) -> list:
        return column.to_numpy(zero_copy_only=False).tolist()  # some ten times as fast as to_pylist

    def ids(text: str) -> np.ndarray:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def encode_all(chunks: list[str]) -> None:
        """Plain words by the model alone; others many in one call, with the special token, which is split off first, between them."""
        plain = objects(pc.match_substring_regex(pc.ascii_lower(pa.array(chunks, pa.string())), PLAIN))
        words = list(compress(chunks, plain))
        # the normalizer and the splitter leave such a word as it is
        made, ends = [], []
        for c in map(str.lower, words):
            made += [t.id for t in model.tokenize(c if c.isascii() else c.encode().decode("latin-1").translate(letters))]
            ends.append(len(made))
        remember(words, np.array(made, "<u4"), ends, 0)
        known.update((c, ids(c).tobytes()) for c in chunks if mark in c)
        others = [c for c, p in zip(chunks, plain, strict=True) if not p and mark not in c]
        for i in range(0, len(others), 2000):
            part = others[i : i + 2000]
            found = ids(mark.join(part))
            remember(part, found, np.append(np.flatnonzero(found == mark_id), len(found)).tolist(), 1)

    def remember(chunks: list[str], found: np.ndarray, ends: list[int], between: int) -> None:
        data, start = found.tobytes(), 0
        for c, end in zip(chunks, ends, strict=True):
            known[c] = data[4 * start : 4 * end]
            start = end + between

    def learn(chunks: list[str]) -> None:
        """A run that ends in marks is a word and its marks, as the tokenizer splits them too."""
        runs = pa.array(chunks, pa.string())
        bare = pc.utf8_rtrim(runs, characters=MARKS)
        words = objects(pc.if_else(pc.match_substring_regex(bare, ENDS_IN_LETTER), bare, runs))
        rests = [c[len(word) :] for c, word in zip(chunks, words, strict=True)]
        encode_all([c for c in {*words, *rests} if c not in known])
        for c, word, rest in zip(chunks, words, rests, strict=True):
            if rest:
                known[c] = known[word] + known[rest]

    def run(texts: list[str] | pa.Array) -> list[bytes]:
        if len(known) > KNOWN_CHUNKS:
            known.clear()
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        texts = pc.fill_null(texts, "")
        split = pc.ascii_split_whitespace(pc.if_else(pc.match_substring_regex(texts, UNFOLDED), texts, pc.ascii_lower(texts)))
        chunks = split.flatten().dictionary_encode()
        distinct = objects(chunks.dictionary)
        found = list(map(known.get, distinct))
        learn([c for c, data in zip(distinct, found, strict=True) if data is None])
        found = [known[c] if data is None else data for c, data in zip(distinct, found, strict=True)]
        all_ids = pa.array(found, pa.large_binary()).take(chunks.indices)
        ends = np.append(0, np.cumsum(pc.binary_length(all_ids).to_numpy()))
        data = memoryview(all_ids.buffers()[2] or b"")
        return [bytes(data[a:b]) for a, b in pairwise(ends[split.offsets.to_numpy()].tolist())]

    return run


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Token pieces of every document: its ids and the end id, cut at ``capacity`` only if longer.

    (id, piece, start, length, ids_crc32, text_hash), and ``ids`` if asked for. A null text is an empty one: one piece, the end id.
    """
    fields = "id bigint, text_hash bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_bytes(tokenizer_path)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            ids, hashes = batch.column(0), batch.column(1)
            for begin, texts in cuts(batch.column(2), CUT_BYTES):
                rows = []
                for k, data in enumerate(tokens(texts)):
                    data += end
                    for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[at : at + 4 * capacity]
                        rows.append((begin + k, piece, at // 4, len(part) // 4, zlib.crc32(part), part))
                at = pa.array([r[0] for r in rows], pa.int64())
                columns = [ids.take(at), hashes.take(at), pa.array([r[1] for r in rows], pa.int32())] + [pa.array([r[k] for r in rows], pa.int64()) for k in (2, 3, 4)]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(r[5], "<u4").astype(np.int64) for r in rows], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in fields.split(", ")])
                rows = columns = at = data = part = texts = None
        tokens = batch = ids = hashes = None
        trim()

    short_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long"), F.xxhash64(text), F.col(text)).mapInArrow(run, fields).withColumnRenamed("id", id_col)


def places(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """Places by length: runs of ranks, the sequence the run begins with, places per sequence, and the offset there."""
    rows: list[tuple[int, int, int, int, int]] = []
    base = 0
    taken: dict[int, int] = {}
    for p in patterns:
        offset = 0
        for n, each in p.items:
            rows.append((n, taken.get(n, 0), base, each, offset))
            taken[n] = taken.get(n, 0) + each * p.count
            offset += n * each
        base += p.count
    rows.sort()
    return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(("length", "rank", "sequence", "each", "offset"))}


def pack(pieces_: DataFrame, by: list[str], capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """Every row of ``pieces_`` with ``sequence_id`` and ``offset``.

    The driver gets one count per length, at most ``capacity`` rows. Pieces are numbered by (length, ``by``) in parallel;
    a piece's number less that of the first of its length is its rank, and the rank gives its place. Rows equal in all
    of these are interchangeable. Lengths of zero and below or above the capacity raise; an empty table gives no rows.
    """
    counts = {r[0]: r[1] for r in pieces_.groupBy(length).count().collect()}
    table = places(plan(counts, capacity))
    first = np.zeros(capacity + 2, np.int64)
    for n, c in counts.items():
        first[n + 1] = c
    first = np.cumsum(first)
    wide = int(max(counts.values(), default=0)) + 1
    starts = table["length"] * wide + table["rank"]

    @pandas_udf("struct<sequence_id: bigint, offset: bigint>")
    def place(rows: pd.Series, lengths: pd.Series) -> pd.DataFrame:
        n = lengths.to_numpy()
        rank = rows.to_numpy() - first[n]
        run = np.searchsorted(starts, n * wide + rank, side="right") - 1
        inside = rank - table["rank"][run]
        each = table["each"][run]
        return pd.DataFrame({"sequence_id": table["sequence"][run] + inside // each, "offset": table["offset"][run] + inside % each * n})

    numbered = number_rows(pieces_, [length, *by], "__row")
    return numbered.withColumn("__place", place("__row", length)).select(*pieces_.columns, "__place.sequence_id", "__place.offset")


def packed(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of all pieces of all documents."""
    cut = saved(pieces(docs, tokenizer_path, capacity, id_col, text), "pieces")
    return pack(cut, [id_col, "text_hash", "piece"], capacity).drop("text_hash")


__all__ = ["Pattern", "best_fit", "pack", "packed", "pieces", "plan", "reduce_dominated"]
