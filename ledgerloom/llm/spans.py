"""Long exact spans shared between texts, by fixed-block anchors.

A common stretch of at least `least` characters holds, wherever it lies, a whole aligned block of least/2 characters of
either text. So the blocks at multiples of least/2 are the reference index, every window of that size is a probe, and each
hit is extended in both directions to a maximal exact repeat.

Sending every window to the index would move many times the text. Two facts keep that local. Both texts of a common
stretch select the same window hashes in it when each takes the least hash of every least/2+1 windows in a row, so only
texts that share a selected hash can have a hit (the selected windows are some 2 in 100). And a selected hash tells which
phases of the block grid its holders have, hence which windows around it can meet a block at all. What is
left out by either cannot hit, so nothing is lost; hashes only nominate, the extension compares characters.

A stretch of period g (a run of blanks, a dotted line) selects a window every g characters, all with one hash; joined as they are
they would make the square of its length, and of the number of texts with such a run. For g up to half a block only the first and the last of such a
chain are kept, and a text's `least`-windows that are periodic throughout, g of them at most however long the run, stand for the
rest: a common stretch inside the run has such a window in both texts; one that reaches out of it holds the chain's last (or
first) window in both. First and last windows of chains are matched with each other directly, with the character beside them; against
other windows they are reference blocks. In the same way a block or window whose surroundings recur in the text is taken once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.workspace import in_workers, materialise

#: Characters that a common stretch has at least.
LEAST = 200
#: The largest block: its phases are kept as bits of two numbers.
LARGEST_BLOCK = 100
#: Characters that a worker hashes at once.
AT_ONCE = 1_000_000

_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_R_INV = np.uint64(pow(int(_R), -1, 1 << 64))
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_powers: dict[str, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse."""
    if not _powers or len(_powers["up"]) < n:
        for name, base in (("up", _R), ("down", _R_INV)):
            x = np.full(n, base, dtype=np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"][:n], _powers["down"][:n]


def window_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every window of `size` code points: prefix sums of a polynomial, brought to one scale."""
    n = len(codes)
    if n < size:
        return np.zeros(0, np.uint64)
    up, down = _power(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_mix(codes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) * up, out=sums[1:])
    return _mix((sums[size:] - sums[:-size]) * down[: n - size + 1])


def _sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """The least or greatest of every `width` values in a row, in log(width) passes."""
    done = 1
    while 2 * done <= width:
        x = pick(x[:-done], x[done:])
        done *= 2
    return pick(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def selected_windows(codes: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the selected windows of texts laid end to end; ends: of the text at each position.

    Selected is what is least among size+1 windows in a row that lie in one text; equals are all selected.
    """
    h = window_hashes(codes, size)
    row = size + 1
    if len(h) < row:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = _sliding(h, row, np.minimum)
    inside = np.arange(len(least)) + (row - 1 + size) <= ends[: len(least)]
    least[~inside] = 0
    edge = np.zeros(row - 1, np.uint64)
    most = _sliding(np.concatenate([edge, least, edge]), row, np.maximum)
    at = np.flatnonzero((h == most) & (h != 0))
    return at, h[at]


#: What a pick is: a window of its own, an end of a chain (a block only), or a hash that is matched with its like.
SINGLE, CHAIN, DIRECT = 0, 1, 2
_LEFT, _RIGHT, _WHOLE = (np.uint64(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD1B54A32D192ED03))


def _keyed(h: np.uint64 | np.ndarray, salt: np.uint64, more: int = 0) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(np.atleast_1d(h).astype(np.uint64) ^ (salt * np.uint64(2 * more + 1)))


def chain_picks(codes: np.ndarray, at: np.ndarray, h: np.ndarray, begin: np.ndarray, end: np.ndarray, size: int, least: int) -> tuple[np.ndarray, ...]:
    """The picks of texts laid end to end from their selected windows: (position, hash, kind, length), chains cut down to what stands for them.

    begin, end: of the text of each window. A chain is a row of equal windows, each the same distance of at most half a block from the next.
    """
    near = (size + 1) // 2
    gap = np.diff(at)
    linked = (h[1:] == h[:-1]) & (begin[1:] == begin[:-1]) & (gap <= near)
    step = np.where(linked, gap, 0)
    before, after = np.concatenate([[0], step]), np.concatenate([step, [0]])
    single = (before == 0) & (after == 0)
    chain = ~single & (before != after)  # an end of a chain, or where two of different steps meet
    pos, key, kind, length = [at[single], at[chain]], [h[single], h[chain]], [np.zeros(single.sum(), np.int32), np.full(chain.sum(), CHAIN, np.int32)], [np.full(single.sum() + chain.sum(), size)]
    firsts = np.flatnonzero((after != 0) & (before != after))
    lasts = np.flatnonzero((before != 0) & (before != after))
    more: list[tuple[int, int, int]] = []  # position, hash, length
    for i, j in zip(firsts, lasts):  # chains in order: each has one first and one last
        g, first, last, lo, hi = int(after[i]), int(at[i]), int(at[j]), int(begin[i]), int(end[i])
        if first > lo:
            more.append((first, int(_keyed(h[i], _LEFT, int(codes[first - 1]))[0]), last + size - first))
        if last + size < hi:
            more.append((last, int(_keyed(h[j], _RIGHT, int(codes[last + size]))[0]), size))
        # The run is the chain and under one step on each side; one of `least` characters has all its windows of that kind selected.
        left = codes[max(lo, first - g + 1) : first] == codes[max(lo, first - g + 1) + g : first + g]
        u = first - (len(left) if left.all() else int((~left[::-1]).argmax()))
        tail = min(hi, last + size + g - 1)
        right = codes[last + size : tail] == codes[last + size - g : tail - g]
        v = last + size + (len(right) if right.all() else int((~right).argmax()))
        whole = min(g, v - u - least + 1)
        if whole > 0:
            hashes = _keyed(window_hashes(codes[u : u + whole - 1 + least], least), _WHOLE)
            more += [(u + k, int(x), v - u - k) for k, x in enumerate(hashes)]
    if more:
        p, k, n = zip(*more)
        pos.append(np.array(p))
        key.append(np.array(k, np.uint64))
        kind.append(np.full(len(more), DIRECT, np.int32))
        length.append(np.array(n))
    return np.concatenate(pos), np.concatenate(key), np.concatenate(kind), np.concatenate(length)


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about AT_ONCE characters."""
    start, total = 0, 0
    for k, t in enumerate(texts):
        if total and total + len(t) > AT_ONCE:
            yield start, k
            start, total = k, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


PICKS = "fp bigint, doc_id bigint, pos int, kind int, length int"


def _select(batches: Iterator[pa.RecordBatch], size: int, least: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
        for i, j in _groups(texts):
            codes = np.frombuffer("".join(texts[i:j]).encode("utf-32-le"), dtype=np.uint32)
            lengths = np.array([len(t) for t in texts[i:j]])
            ends = np.cumsum(lengths)
            at, h = selected_windows(codes, np.repeat(ends, lengths), size)
            own = np.searchsorted(ends, at, side="right")
            at, h, kind, length = chain_picks(codes, at, h, (ends - lengths)[own], ends[own], size, least)
            own = np.searchsorted(ends, at, side="right")
            pos = at - (ends - lengths)[own]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[i:j][own], pa.int64()), pa.array(pos, pa.int32()), pa.array(kind, pa.int32()), pa.array(length, pa.int32())], names=["fp", "doc_id", "pos", "kind", "length"])


def _bits(lo: int, hi: int, half: int) -> list[int]:
    return [k for k in range(half) if lo >> k & 1] + [half + k for k in range(half) if hi >> k & 1]


PARTS = "kind int, hash bigint, doc_id bigint, pos int, text string"
BLOCK, WINDOW, REGION = 0, 1, 2


def _once(places: np.ndarray, h: np.ndarray, text: str, size: int, reach: int) -> np.ndarray:
    """Of the places with one hash and the same `reach` characters on both sides, the first."""
    _, first, n = np.unique(h[places], return_index=True, return_counts=True)
    if (n == 1).all():
        return places
    seen: set[tuple[str, str]] = set()
    kept = []
    for p in places.tolist():
        around = (text[max(0, p - reach) : p], text[p : p + size + reach])
        if around not in seen:
            seen.add(around)
            kept.append(p)
    return np.array(kept, np.int64)


def _anchors(h: np.ndarray, text: str, hits: list[dict], size: int, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The blocks, windows and directly matched hashes of a text: (kind, positions, hashes)."""
    half = -(-size // 2)
    direct = [x for x in hits if x["kind"] == DIRECT]
    if direct:
        pos, key = np.array([x["pos"] for x in direct]), np.array([x["fp"] for x in direct], np.int64)
        yield BLOCK, pos, key
        yield WINDOW, pos, key
    near = np.array(sorted(x["pos"] for x in hits if x["kind"] != DIRECT), np.int64)
    if not len(near):
        return
    first = -(-np.maximum(0, near - size) // size) * size
    blocks = (first[:, None] + np.arange(3) * size).ravel()
    blocks = np.unique(blocks[(blocks <= np.repeat(near + size, 3)) & (blocks < len(h))])
    wanted = np.zeros(len(h), bool)
    by_phases: dict[tuple[int, int], list[int]] = {}
    for x in hits:
        if x["kind"] == SINGLE:
            by_phases.setdefault((x["lo"], x["hi"]), []).append(x["pos"])
    for (lo, hi), places in by_phases.items():
        phases = np.array(_bits(lo, hi, half), np.int64)
        shifts = np.concatenate([-phases, size - phases, [-size] if (phases == 0).any() else []]).astype(np.int64)
        at = (np.array(places, np.int64)[:, None] + shifts).ravel()
        wanted[at[(at >= 0) & (at < len(h))]] = True
    for kind, places in ((BLOCK, blocks), (WINDOW, np.flatnonzero(wanted))):
        places = _once(places, h, text, size, least - size)
        yield kind, places, h[places]


def _parts(batches: Iterator[pa.RecordBatch], size: int, least: int) -> Iterator[pa.RecordBatch]:
    """Of each text: the reference blocks and the probing windows around its shared hashes, and the text around them."""
    reach = least - size
    for b in batches:
        out: list[list] = [[], [], [], []]
        regions: list[list] = [[], [], []]
        for doc, text, hits in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            h = window_hashes(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32), size).view(np.int64)
            for kind, places, hashes in _anchors(h, text, hits, size, least):
                for col, x in zip(out, (np.full(len(places), kind, np.int32), hashes, np.full(len(places), doc, np.int64), places)):
                    col.append(x)
            spans: list[list[int]] = []
            for s, e in sorted((max(0, x["pos"] - reach), min(len(text), x["pos"] + x["length"] + reach)) for x in hits):
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], e)
                else:
                    spans.append([s, e])
            for s, e in spans:
                for col, x in zip(regions, (doc, s, text[s:e])):
                    col.append(x)
        n, m = sum(map(len, out[0])), len(regions[0])
        arrays = [np.concatenate([*c, np.full(m, fill)]) if c else np.full(m, fill) for c, fill in zip(out, (REGION, 0, 0, 0))]
        arrays[2][n:], arrays[3][n:] = regions[0], regions[1]
        types = (pa.int32(), pa.int64(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([*[pa.array(c.astype(np.int64), t) for c, t in zip(arrays, types)], pa.array([None] * n + regions[2], pa.string())], names=["kind", "hash", "doc_id", "pos", "text"])


def block_size(least: int) -> int:
    """The size of blocks and windows: half of a stretch, so that each stretch holds an aligned block, or less."""
    if least < 8:
        raise ValueError("a common stretch has 8 characters at least")
    return min(least // 2, LARGEST_BLOCK)


def anchor_parts(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """Blocks, windows and regions of all texts that may have a common stretch of `least` characters, written once."""
    size = block_size(least)
    half = -(-size // 2)
    texts = documents.where(F.char_length("text") >= least).select(F.col("doc_id").cast("bigint"), "text")
    picked = in_workers(texts).mapInArrow(lambda it: _select(it, size, least), PICKS)
    phase = F.pmod("pos", F.lit(size))
    bit = lambda low: F.bit_or(F.when((F.col("kind") != DIRECT) & (phase >= low) & (phase < low + half if low == 0 else phase < size), F.call_function("shiftleft", F.lit(1).cast("bigint"), (phase - low).cast("int"))).otherwise(F.lit(0).cast("bigint")))
    # Counted before the shuffle too, so a hash that a third of all texts have is one row per task.
    shared = picked.groupBy("fp").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), bit(0).alias("lo"), bit(half).alias("hi")).where("a < b").select("fp", "lo", "hi")
    hits = picked.join(shared, "fp").groupBy("doc_id").agg(F.collect_list(F.struct("fp", "pos", "kind", "length", "lo", "hi")).alias("hits"))
    return materialise(texts.join(hits, "doc_id").select("doc_id", "text", "hits").mapInArrow(lambda it: _parts(it, size, least), PARTS), "anchors")


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading elements agree."""
    n = min(len(a), len(b))
    diff = a[:n] != b[:n]
    return int(diff.argmax()) if diff.any() else n


def _region(regions: list[tuple[int, np.ndarray]], pos: int) -> tuple[int, np.ndarray] | None:
    for start, codes in regions:
        if start <= pos < start + len(codes):
            return start, codes
    return None


def maximal_repeats(anchors: list[tuple[int, int]], left: list[tuple[int, str]], right: list[tuple[int, str]], size: int, least: int, one: bool = False) -> list[tuple[int, int, int]]:
    """Anchors (position in a, in b) extended to maximal exact repeats of at least `least`: (start in a, start in b, length). With `one` the first found."""
    code = lambda t: np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32)
    ra, rb = [(s, code(t)) for s, t in left], [(s, code(t)) for s, t in right]
    found: list[tuple[int, int, int]] = []
    done: dict[int, int] = {}
    for pa_, pb in sorted(set(anchors)):
        if done.get(pa_ - pb, -1) >= pa_ + size:
            continue  # inside the repeat that an earlier anchor of this diagonal grew to
        x, y = _region(ra, pa_), _region(rb, pb)
        if x is None or y is None:
            continue
        i, j = pa_ - x[0], pb - y[0]
        ahead = _common(x[1][i:], y[1][j:])
        back = _common(x[1][:i][::-1], y[1][:j][::-1])
        done[pa_ - pb] = max(done.get(pa_ - pb, -1), pa_ + ahead)
        if ahead >= size and ahead + back >= least:
            found.append((pa_ - back, pb - back, back + ahead))
            if one:
                break
    return found


def shared_spans(documents: DataFrame, least: int = LEAST, one: bool = False) -> DataFrame:
    """Maximal exact repeats of at least `least` characters between two texts: doc_id_a < doc_id_b, start_a, start_b, length.

    Texts are compared as stored, by characters. Null texts and texts under `least` characters have none; a text that
    was delivered under two ids is shared as a whole; a row with the same id again is the same document. Repeats within one text
    are no case. One row per pair and repeat: pairs are never capped. Where a stretch recurs within a text (a run of one
    character, a line that is repeated), places with the same surroundings are probed once, so of the repeats of a pair that differ only in
    which of those places they take, not all come out; every pair that has a common stretch comes out. With `one`, one row per pair.
    """
    size = block_size(least)
    parts = anchor_parts(documents, least)
    block = parts.where(F.col("kind") == BLOCK).select("hash", F.col("doc_id").alias("r"), F.col("pos").alias("rp"))
    window = parts.where(F.col("kind") == WINDOW).select("hash", F.col("doc_id").alias("q"), F.col("pos").alias("qp"))
    hit = block.join(window, "hash").where("r <> q")
    first = F.col("r") < F.col("q")
    ab = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    pairs = hit.select(ab("r", "q").alias("a"), ab("q", "r").alias("b"), F.struct(ab("rp", "qp").alias("x"), ab("qp", "rp").alias("y")).alias("at"))
    pairs = pairs.groupBy("a", "b").agg(F.collect_set("at").alias("anchors"))
    regions = parts.where(F.col("kind") == REGION).groupBy("doc_id").agg(F.collect_list(F.struct("pos", "text")).alias("regions"))
    rows = pairs.join(regions.select(F.col("doc_id").alias("a"), F.col("regions").alias("left")), "a").join(regions.select(F.col("doc_id").alias("b"), F.col("regions").alias("right")), "b")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[int]] = [[], [], [], [], []]
            for r in b.to_pylist():
                texts = [[(x["pos"], x["text"]) for x in r[side]] for side in ("left", "right")]
                for s, t, n in maximal_repeats([(x["x"], x["y"]) for x in r["anchors"]], *texts, size, least, one):
                    for col, v in zip(out, (r["a"], r["b"], s, t, n)):
                        col.append(v)
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["doc_id_a", "doc_id_b", "start_a", "start_b", "length"])

    return rows.select("a", "b", "anchors", "left", "right").mapInArrow(extend, "doc_id_a bigint, doc_id_b bigint, start_a int, start_b int, length int")


def sharing_pairs(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """Pairs of documents with a common stretch of at least `least` characters: doc_id_a < doc_id_b."""
    return shared_spans(documents, least, one=True).select("doc_id_a", "doc_id_b")


def text_links(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """One row per document: doc_id, class_id (the least doc_id with the same text), n_links (other texts it has a common stretch with).

    Copies are compared once, by their class, so a large group of copies costs no pairs. A null text is a class of its own; a row with
    the same id again repeats its row.
    """
    named = documents.select(F.col("doc_id").cast("bigint"), "text", F.sha2("text", 256).alias("digest"))
    classes = named.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("class_id"))
    members = named.select("doc_id", "digest").join(classes, "digest", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    pairs = sharing_pairs(named.join(classes.select(F.col("class_id").alias("doc_id")), "doc_id", "left_semi"), least)
    both = pairs.select(F.explode(F.array("doc_id_a", "doc_id_b")).alias("class_id"))
    return members.join(both.groupBy("class_id").agg(F.count("*").alias("n_links")), "class_id", "left").select("doc_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


STRETCHES = "hash bigint, doc_id bigint, pos int, length int"


def _long_windows(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The windows of `least` characters of each region; equal ones that touch or overlap, as in a run, are one stretch."""
    for b in batches:
        for doc, pos, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            h = window_hashes(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32), least).view(np.int64)
            order = np.argsort(h, kind="stable")
            key, at = h[order], order
            first = np.ones(len(key), bool)
            first[1:] = (key[1:] != key[:-1]) | (np.diff(at) > least)
            begin = np.flatnonzero(first)
            end = np.append(begin[1:], len(at)) - 1
            start, length = pos + at[begin], at[end] - at[begin] + least
            yield pa.RecordBatch.from_arrays([pa.array(key[begin]), pa.array(np.full(len(begin), doc, np.int64)), pa.array(start.astype(np.int32)), pa.array(length.astype(np.int32))], names=["hash", "doc_id", "pos", "length"])


def shared_amounts(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """How much of each document is shared elsewhere: doc_id, n_chars, shared_chars, shared_ratio, n_spans.

    A character is shared if it lies in a stretch of `least` characters that another document has too. In time linear in what is
    shared, without pairs: within the regions around shared hashes, every window of `least` characters that two documents hold
    is marked, and marks are united per document, sorted and not collected. Every document has a row: null texts with null n_chars and 0 shared.
    """
    parts = anchor_parts(documents, least).where(F.col("kind") == REGION).select("doc_id", "pos", "text")
    long = materialise(in_workers(parts).mapInArrow(lambda it: _long_windows(it, least), STRETCHES), "windows")
    held = long.groupBy("hash").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("hash")
    # Stretches by their start: each adds what reaches beyond all before it, and begins a span if it starts beyond them.
    end = F.col("pos") + F.col("length")
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    marks = long.join(held, "hash", "left_semi").select("doc_id", "pos", end.alias("end"), F.max(end).over(before).alias("reached"))
    added = F.greatest(F.lit(0), F.col("end") - F.greatest("pos", "reached"))
    amounts = marks.groupBy("doc_id").agg(F.sum(added).cast("int").alias("shared_chars"), F.count_if(F.col("reached").isNull() | (F.col("pos") > F.col("reached"))).cast("int").alias("n_spans"))
    out = documents.select("doc_id", F.char_length("text").alias("n_chars")).join(amounts, "doc_id", "left")
    shared = F.coalesce("shared_chars", F.lit(0))
    return out.select("doc_id", "n_chars", shared.alias("shared_chars"), F.when(F.col("n_chars") > 0, shared / F.col("n_chars")).otherwise(0.0).alias("shared_ratio"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"))
