"""Removal of repeated substrings over a whole corpus, by suffix sorting.

Every window of `length` bytes (200) has one anchor: the byte string of `GRAM` bytes within it whose hash is smallest,
leftmost on ties. Equal windows have equal anchors at equal places, so a window can only repeat among the windows whose anchor
is the same string. That deals the suffixes of the corpus into buckets by a key of about one row in 80 bytes:

1. each text gives a row for each run of windows with one anchor: hash of the anchor, 128-bit hash of the bytes the run covers;
2. anchors that occur once are dropped; of runs alike by their hash, which are one class, the bytes of two are fetched;
3. the runs fetched for an anchor meet in a task: the linear suffix sorter orders what follows and what precedes the anchor, common
   prefixes of neighbours are compared byte by byte, and a window repeats if another run agrees with it far enough on both sides;
4. where an anchor has one class only, the two runs fetched join those beside them in the same two texts to stretches, and the sorter
   finds these equal. So no two runs are equal but by the sorter; only then do all others of a class count as repeated too.

A bucket with more than `cap` distinct runs is not brought together: its runs are cut into shorter ones, whose windows share
more bytes, and dealt out by those. At the last level a run is a single window.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm.common import discard, fresh, mapped, raw, stored
from docweave.llm.suffix_array import suffix_array

GRAM = 40
#: Bytes of a symbol of the suffix sorter.
BLOCK = 100
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Positions lie in the low bits of the keys that the sliding minimum compares.
_POSITION = np.uint64((1 << 24) - 1)
_PIECE = 1 << 22
_RUN = [("at", pa.int64()), ("low", pa.int16()), ("high", pa.int16()), ("g", pa.int64()), ("f", pa.int64()), ("h", pa.int64())]
_RUN_DDL = "at long, low short, high short, g long, f long, h long"
#: The runs of a stretch: places within it, class, and how many rows the class has.
_INNER = pa.list_(pa.struct([("at", pa.int64()), ("low", pa.int16()), ("high", pa.int16()), ("f", pa.int64()), ("h", pa.int64()), ("n", pa.int64())]))
_INNER_DDL = "array<struct<at: long, low: short, high: short, f: long, h: long, n: long>>"


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position on."""
    with np.errstate(over="ignore"):
        powers, sums, width = {1: _BASE}, {1: data.astype(np.uint64) + np.uint64(1)}, 1
        while 2 * width <= GRAM:
            h, b = sums[width], powers[width]
            sums[2 * width], powers[2 * width] = h[:-width] * b + h[width:], b * b
            width *= 2
        out, have = sums[width], width
        for w in (8,):  # 32 + 8 bytes
            out, have = out[:-w] * powers[w] + sums[w][have:], have + w
        assert have == GRAM
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
        out *= np.uint64(0x94D049BB133111EB)
        out ^= out >> np.uint64(32)
    return out


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    if have < width:
        step = width - have
        values = np.minimum(values[:-step], values[step:])
    return values


def runs_of(data: np.ndarray, ends: np.ndarray, length: int):
    """The runs of windows with one anchor over texts that lie end to end in data (at most 2**24 bytes).

    Returns anchor, first window, last window (positions in data) and the anchors' hashes.
    """
    grams = gram_hashes(data)
    keys = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_minimum(keys, length - GRAM + 1) & _POSITION).astype(np.int64)
    whole = np.ones(len(anchor) + 1, dtype=bool)  # windows that lie within one text
    whole[-1] = False
    starts = np.concatenate([[0], ends[:-1]])
    for lo, hi in zip(np.maximum(starts, ends - length + 1), ends):
        whole[lo:hi] = False
    new = whole[:-1].copy()
    new[1:] &= ~(whole[:-2] & (anchor[1:] == anchor[:-1]))
    last = whole[:-1].copy()
    last[:-1] &= ~(whole[1:-1] & (anchor[1:] == anchor[:-1]))
    first, last = np.flatnonzero(new), np.flatnonzero(last)
    return anchor[first], first, last, grams[anchor[first]]


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digests as two longs each."""
    both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _runs(batches, length):
    """Rows of runs: doc_id, th, at (anchor's place in its text), low and high (windows start at - high to at - low), g (the anchor's hash), f and h (that of the covered bytes)."""

    def emit(row, data, pieces):
        ends = np.cumsum([len(p) for _, _, p in pieces])
        if len(data) < length:
            return None
        anchor, first, last, grams = runs_of(data, ends, length)
        if not len(anchor):
            return None
        which = np.searchsorted(ends, first, side="right")
        base = np.array([at - (e - len(p)) for (_, at, p), e in zip(pieces, ends)])[which]
        view = data.tobytes()
        f, h = _halves([xxhash.xxh3_128_digest(view[a : b + length]) for a, b in zip(first.tolist(), last.tolist())])
        rows = np.array([r for r, _, _ in pieces])[which]
        return rows, anchor + base, anchor - last, anchor - first, grams.view(np.int64), f, h

    for b in batches:
        found, pieces, size = [], [], 0
        for row, text in enumerate(raw(b.column(2))):
            text = text or b""
            for at in range(0, max(1, len(text) - length + 1), _PIECE):
                part = text[at : at + _PIECE + length - 1]
                if len(part) < length:
                    continue
                pieces.append((row, at, part))
                size += len(part)
                if size >= 1 << 18:
                    found.append(emit(row, np.frombuffer(b"".join(p for _, _, p in pieces), np.uint8), pieces))
                    pieces, size = [], 0
        if pieces:
            found.append(emit(row, np.frombuffer(b"".join(p for _, _, p in pieces), np.uint8), pieces))
        found = [x for x in found if x is not None]
        if found:
            rows, *rest = (np.concatenate(x) for x in zip(*found))
            taken = pa.array(rows)
            columns = [b.column(0).take(taken), b.column(1).take(taken)] + [pa.array(x).cast(t) for x, (_, t) in zip(rest, _RUN)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", *(n for n, _ in _RUN)])


def _common(strings: np.ndarray) -> np.ndarray:
    """For rows of equal width: how many first bytes each shares with the row before it."""
    differ = strings[1:] != strings[:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), strings.shape[1])
    return np.concatenate([[0], shared])


def repeated_windows(covered: list[bytes], low: np.ndarray, high: np.ndarray, length: int) -> np.ndarray:
    """For each run, which of its windows (column: distance from window start to anchor) occur in another run too.

    covered[i] holds the bytes from high[i] before the anchor on, up to the end of the window that starts low[i] before it. Runs with
    different anchors may be mixed. What follows and precedes the anchors is ordered by suffix_array, over an alphabet of BLOCK-byte
    blocks.
    """
    n, widest = len(covered), length - GRAM
    wide, back_wide = -(-length // BLOCK), -(-widest // BLOCK)
    after = np.zeros((n, wide * BLOCK), dtype=np.uint8)
    before = np.zeros((n, back_wide * BLOCK), dtype=np.uint8)
    for i, (text, h) in enumerate(zip(covered, high.tolist())):
        text = np.frombuffer(text, np.uint8)
        after[i, : len(text) - h] = np.where(text[h:], text[h:], 255)  # zeros are past the end; 255 is in no UTF-8 text
        before[i, :h] = np.where(text[:h], text[:h], 255)[::-1]
    blocks = np.concatenate([after.reshape(-1, BLOCK), before.reshape(-1, BLOCK)])
    _, rank = np.unique(blocks.view(f"S{BLOCK}").ravel(), return_inverse=True)
    text = np.zeros((n, wide + back_wide + 2), dtype=np.int64)  # two strings a run, each ended by 0
    text[:, :wide] = rank[: n * wide].reshape(n, -1) + 1
    text[:, wide + 1 : -1] = rank[n * wide :].reshape(n, -1) + 1
    order = np.array(suffix_array(text.ravel().tolist()), dtype=np.int64)
    row, column = np.divmod(order, text.shape[1])
    by_after, by_before = row[column == 0], row[column == wide + 1]
    share_after, share_before = _common(after[by_after]), _common(before[by_before])

    repeated = np.zeros((n, widest + 1), dtype=bool)
    class_after, class_before = np.empty(n, np.int64), np.empty(n, np.int64)
    for back in range(int(low.min()), int(high.max()) + 1):
        own = np.flatnonzero((low <= back) & (back <= high))
        if len(own) < 2:
            continue
        class_after[by_after] = np.cumsum(share_after < length - back)
        class_before[by_before] = np.cumsum(share_before < back) if back else 0
        _, inverse, count = np.unique(class_after[own] * (n + 1) + class_before[own], return_inverse=True, return_counts=True)
        repeated[own, back] = count[inverse] > 1
    return repeated


def _spans_of(batches, length, least):
    """doc_id, th, s, e, f, h, whole: the bytes of each row's windows that repeat, and whether all of a class's do that has more than the rows
    here. Rows come grouped by g; whole groups are compared."""
    names = ["doc_id", "th", "s", "e", "f", "h", "whole"]

    def compare(table):
        if table.num_rows < 2:
            return None
        low, high, at = (table.column(c).to_numpy().astype(np.int64) for c in ("low", "high", "at"))
        found = repeated_windows(table.column("covered").to_pylist(), low, high, length)
        edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, first = np.nonzero(edge == 1)
        _, past = np.nonzero(edge == -1)
        taken = pa.array(row)
        whole = (found.sum(axis=1) == high - low + 1) & (table.column("n").to_numpy() > 2)
        columns = [table.column("doc_id").combine_chunks().take(taken), table.column("th").combine_chunks().take(taken)]
        columns += [pa.array(at[row] - past + 1), pa.array(at[row] - first + length)]
        columns += [table.column("f").combine_chunks().take(taken), table.column("h").combine_chunks().take(taken), pa.array(whole[row])]
        return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names=names)

    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.num_rows
        if size >= least:
            table = pa.Table.from_batches(held)
            g = table.column("g").to_numpy()
            closed = np.flatnonzero(g != g[-1])
            open_ = int(closed[-1]) + 1 if len(closed) else 0  # the last group may go on in the next batch
            if open_:
                out = compare(table.slice(0, open_))
                if out is not None:
                    yield out
                held = table.slice(open_).to_batches()
                size = table.num_rows - open_
    if held:
        out = compare(pa.Table.from_batches(held))
        if out is not None:
            yield out


def equal_classes(strings: list[bytes]) -> np.ndarray:
    """Numbers of the strings, alike for equal ones: neighbours in the order of suffix_array, over BLOCK-byte symbols, are compared."""
    wide = np.array([-(-len(s) // BLOCK) for s in strings])
    padded = np.frombuffer(b"".join(s.replace(b"\0", b"\xff").ljust(w * BLOCK, b"\0") for s, w in zip(strings, wide.tolist())), f"S{BLOCK}")
    _, rank = np.unique(padded, return_inverse=True)
    begin = np.cumsum(wide + 1) - wide - 1
    symbols = np.zeros(len(rank) + len(strings), dtype=np.int64)  # each string ends by 0
    symbols[np.arange(len(rank)) + np.repeat(np.arange(len(strings)), wide)] = rank + 1
    at = np.empty(len(symbols), np.int64)
    at[np.array(suffix_array(symbols.tolist()), dtype=np.int64)] = np.arange(len(symbols))
    order = np.argsort(at[begin])
    number, out = -1, np.empty(len(strings), np.int64)
    for k, i in enumerate(order.tolist()):
        number += k == 0 or strings[i] != strings[order[k - 1]]
        out[i] = number
    return out


def _stretches(batches, length, most: int = 1 << 16):
    """Runs that two texts have at one distance, joined where they overlap: two rows for each stretch of about `most` bytes or less."""
    names = ["doc_id", "th", "at", "low", "high", "g", "f", "h", "n", "crowd", "k", "s", "e", "runs"]
    for b in batches:
        row, second, starts, ends, keys, inner = [], [], [], [], [], []
        for i, (key, delta, runs) in enumerate(zip(b.column("key").to_pylist(), b.column("delta").to_pylist(), b.column("runs").to_pylist())):
            runs.sort(key=lambda r: r["at"] - r["high"])
            held: list[dict] = []
            s = e = 0
            for r in [*runs, None]:
                a, z = (r["at"] - r["high"], r["at"] - r["low"] + length) if r else (0, 0)
                if held and (r is None or a > e or e - s >= most):
                    for k in (0, 1):
                        row.append(i)
                        second.append(k)
                        starts.append(s + delta * k)
                        ends.append(e + delta * k)
                        keys.append(xxhash.xxh3_64_intdigest(f"{key} {s}"))
                        inner.append(None if k else held)
                    held = []
                if r:
                    s, e = (a, z) if not held else (s, max(e, z))
                    held.append(r | {"at": r["at"] - s})
        taken, n = pa.array(row, pa.int64()), len(row)
        second_doc = np.array(second, dtype=bool)
        side = lambda one, two: pc.if_else(pa.array(second_doc), b.column(two).take(taken), b.column(one).take(taken))
        zeros = lambda t: pa.array(np.zeros(n, np.int64)).cast(t)
        columns = [side("d1", "d2"), side("t1", "t2"), pa.array(starts, pa.int64()), zeros(pa.int16()), zeros(pa.int16()), pa.array(np.array(keys, dtype=np.uint64).view(np.int64)), zeros(pa.int64()), zeros(pa.int64()), zeros(pa.int64()), zeros(pa.int64())]
        columns += [pa.array(second, pa.int32()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(inner, _INNER)]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def _equal_stretches(batches, length, least: int = 1 << 20):
    """What _spans_of gives, for pairs of stretches; rows come grouped by g. Where two differ after all, their runs are compared one by one."""
    names = ["doc_id", "th", "s", "e", "f", "h", "whole"]

    def compare(rows):
        pairs: dict[int, dict[int, dict]] = {}
        for r in rows:
            pairs.setdefault(r["g"], {})[r["k"]] = r
        both = [(p[0], p[1]) for p in pairs.values() if len(p) == 2]
        number = equal_classes([x["covered"] for p in both for x in p]).reshape(-1, 2)
        out = []
        for (a, z), same in zip(both, (number[:, 0] == number[:, 1]).tolist()):
            if same:
                out += [(x["doc_id"], x["th"], x["s"], x["e"], 0, 0, False) for x in (a, z)]
                out += [(a["doc_id"], a["th"], a["s"] + r["at"] - r["high"], a["s"] + r["at"] - r["low"] + length, r["f"], r["h"], True) for r in a["runs"] if r["n"] > 2]
                continue
            for r in a["runs"]:
                own = slice(r["at"] - r["high"], r["at"] - r["low"] + length)
                found = repeated_windows([a["covered"][own], z["covered"][own]], np.array([r["low"]] * 2), np.array([r["high"]] * 2), length)
                for x, back in zip((a, z), found):
                    out += [(x["doc_id"], x["th"], x["s"] + r["at"] - int(d), x["s"] + r["at"] - int(d) + length, 0, 0, False) for d in np.flatnonzero(back)]
                if found[0, r["low"] : r["high"] + 1].all() and r["n"] > 2:
                    out.append((a["doc_id"], a["th"], a["s"] + own.start, a["s"] + own.stop, r["f"], r["h"], True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (doc_type, *(pa.int64(),) * 5, pa.bool_()))], names=names) if out else None

    held, size = [], 0
    for b in batches:
        doc_type = b.schema.field("doc_id").type
        for r in b.to_pylist():
            if size >= least and r["g"] != held[-1]["g"]:
                if (found := compare(held)) is not None:
                    yield found
                held, size = [], 0
            held.append(r)
            size += len(r["covered"])
    if held and (found := compare(held)) is not None:
        yield found


def _cut(batches, length, width):
    """Runs cut at multiples of width; g becomes the hash of the bytes that all windows of the cut share, f and h that of what it covers."""
    for b in batches:
        rows, low, high, g, digests, covered = [], [], [], [], [], []
        for i, (text, lo, hi) in enumerate(zip(b.column("covered").to_pylist(), b.column("low").to_pylist(), b.column("high").to_pylist())):
            for cell in range(lo // width, hi // width + 1):
                first, last = cell * width, cell * width + width - 1
                a, z = max(lo, first), min(hi, last)
                part = text[hi - z : hi - a + length]
                rows.append(i)
                low.append(a)
                high.append(z)
                g.append(xxhash.xxh3_64_intdigest(text[hi - first : hi + length - last], seed=cell + 1))
                digests.append(xxhash.xxh3_128_digest(part))
                covered.append(part)
        taken = pa.array(rows, pa.int64())
        f, h = _halves(digests)
        new = {"low": pa.array(low, pa.int16()), "high": pa.array(high, pa.int16()), "g": pa.array(np.array(g, dtype=np.uint64).view(np.int64)), "f": pa.array(f), "h": pa.array(h), "covered": pa.array(covered, pa.binary())}
        yield pa.RecordBatch.from_arrays([new[c] if c in new else b.column(c).take(taken) for c in b.schema.names], names=b.schema.names)


def _salted(rows: DataFrame) -> DataFrame:
    """rows with a salt, so many values of it that even a class of all rows is dealt out over them by some 20,000."""
    salts = max(128, rows.count() // 20_000)
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "th", "at", "low"), F.lit(salts)))


def _of_classes(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """The salted rows whose f and h are among those of classes."""
    keys = rows.select("f", "h", "salt").distinct().join(classes, ["f", "h"])  # at most a row for each class and salt
    return rows.join(keys, ["f", "h", "salt"], "left_semi")


def _fetched(known: DataFrame, cap: int) -> DataFrame:
    """The rows whose bytes the sorter needs: one of each class or two, if there are as many, by the key under which they meet.

    known: g, f, h, n, the first and last row r, r2 of each class, and how many classes g has. Classes of a crowded g meet by cuts, and by
    themselves to find their rows equal.
    """
    row = lambda r, k, g, crowd: F.struct(F.col(r).alias("r"), F.lit(k).alias("k"), g.alias("g"), crowd.alias("crowd"))
    g, crowd, own = F.col("g"), F.col("crowd"), F.xxhash64("g", "f", "h")
    together = F.when(F.col("n") > 1, F.array(row("r", 0, g, crowd), row("r2", 1, g, crowd))).otherwise(F.array(row("r", 0, g, crowd)))
    alone = F.lit(1).cast("long")  # never crowded
    apart = F.when(F.col("n") > 1, F.array(row("r", 0, g, crowd), row("r", 0, own, alone), row("r2", 1, own, alone))).otherwise(F.array(row("r", 0, g, crowd)))
    return known.select("f", "h", "n", F.explode(F.when(crowd <= cap, together).otherwise(apart)).alias("x")).select("x.r.*", "x.k", "x.g", "f", "h", "n", "x.crowd")


def repeated_spans(documents: DataFrame, id_col: str, text_col: str, length: int = 200, cap: int = 1024) -> DataFrame:
    """doc_id, th, spans: for each text with repeated windows the bytes that they cover, as unsorted [s, e) pairs.

    th is the hash of the text; with the id it names the row. Repeated rows have one row here, which holds for each of them.
    """
    kind = documents.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = documents.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    runs = stored(mapped(docs.where(F.octet_length("text") >= length), lambda b: _runs(b, length), f"doc_id {kind}, th long, {_RUN_DDL}"), "runs")
    anchors = stored(runs.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"), "anchors")  # apart, so that the join of a hot anchor can be split
    shared = stored(runs.join(anchors, "g", "left_semi"), "shared-runs")
    discard(runs, anchors)
    one = F.struct("doc_id", "th", "at", "low", "high")
    classes = stored(shared.groupBy("g", "f", "h").agg(F.count("*").alias("n"), F.min(one).alias("r"), F.max(one).alias("r2")), "classes")
    known = classes.join(classes.groupBy("g").agg(F.count("*").alias("crowd")), "g")
    columns = ["at", "low", "high", "g", "f", "h", "n", "crowd", "k", "s", "e", "runs"]
    needed = _fetched(known.where("crowd > 1"), cap).withColumns({"s": F.expr("at - high"), "e": F.expr(f"at - low + {length}"), "runs": F.lit(None).cast(_INNER_DDL)})
    pairs = known.where("crowd = 1 AND n > 1").select("r.*", F.col("r2.doc_id").alias("d2"), F.col("r2.th").alias("t2"), F.expr("r2.at - r.at").alias("delta"), "f", "h", "n")
    pairs = pairs.withColumnsRenamed({"doc_id": "d1", "th": "t1"}).groupBy("d1", "t1", "d2", "t2", "delta").agg(F.collect_list(F.struct("at", "low", "high", "f", "h", "n")).alias("runs"))
    pairs = pairs.withColumn("key", F.xxhash64("d1", "t1", "d2", "t2", "delta"))
    piece_ddl = f"doc_id {kind}, th long, {_RUN_DDL}, n long, crowd long, k int, s long, e long, runs {_INNER_DDL}"
    needed = needed.select("doc_id", "th", *columns).unionByName(mapped(pairs, lambda b: _stretches(b, length), piece_ddl))
    needed = needed.groupBy("doc_id", "th").agg(F.collect_list(F.struct(*columns)).alias("w"))  # some for every 80 bytes of the text

    def extract(batches):
        kinds = [*(t for _, t in _RUN), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), _INNER]
        for b in batches:
            for row, (text, wanted) in enumerate(zip(raw(b.column(2)), b.column(3).to_pylist())):
                found = [pa.array([w[c] for w in wanted], t) for c, t in zip(columns, kinds)]
                taken = pa.array([row] * len(wanted), pa.int64())
                covered = pa.array([text[w["s"] : w["e"]] for w in wanted], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).take(taken), b.column(1).take(taken), *found, covered], names=["doc_id", "th", *columns, "covered"])

    here = docs.alias("d").join(needed.alias("w"), F.expr("d.doc_id <=> w.doc_id AND d.th = w.th")).select("d.doc_id", "d.th", "d.text", "w.w")
    members = mapped(here, extract, f"{piece_ddl}, covered binary")
    if not docs.groupBy("doc_id", "th").count().where("count > 1").isEmpty():  # repeated rows give each of their runs more than once
        members = members.dropDuplicates(["doc_id", "th", "at", "low", "g", "k"])
    members = stored(members, "members")
    discard(classes)
    found_ddl = f"doc_id {kind}, th long, s long, e long, f long, h long, whole boolean"
    width, rows, spans, done = length - GRAM + 1, shared, [], [shared]
    while True:
        small = members.where(F.col("crowd").between(1, cap)).drop("s", "e", "runs").repartition("g").sortWithinPartitions("g")
        found = mapped(small, lambda b: _spans_of(b, length, 2 * cap), found_ddl)
        if rows is shared:
            stretches = members.where("crowd = 0").select("doc_id", "th", "g", "k", "s", "e", "runs", "covered").repartition("g").sortWithinPartitions("g")
            found = found.union(mapped(stretches, lambda b: _equal_stretches(b, length), found_ddl))
        found = stored(found, "found")
        done += [found, rows]
        spans.append(found.select("doc_id", "th", "s", "e"))
        alike = _of_classes(_salted(rows), found.where("whole").select("f", "h").distinct())
        spans.append(alike.select("doc_id", "th", F.expr("at - high").alias("s"), F.expr(f"at - low + {length}").alias("e")))
        crowded = members.where(F.col("crowd") > cap)
        if width == 1 or crowded.isEmpty():
            break
        width = -(-width // 4)
        rows = stored(mapped(crowded.select("doc_id", "th", *(c for c, _ in _RUN), "covered"), lambda b, w=width: _cut(b, length, w), f"doc_id {kind}, th long, {_RUN_DDL}, covered binary"), "cut-runs")
        each = F.struct("doc_id", "th", "at", "low", "high", "covered")
        classes = rows.groupBy("g", "f", "h").agg(F.count("*").alias("n"), F.min(each).alias("r"), F.max(each).alias("r2"))
        known = classes.join(classes.groupBy("g").agg(F.count("*").alias("crowd")), "g").where("crowd > 1 OR n > 1")
        members, before = stored(_fetched(known, cap), "members"), members
        discard(before)
    every = reduce(DataFrame.union, spans)
    out = stored(every.groupBy("doc_id", "th").agg(F.collect_set(F.struct("s", "e")).alias("spans")), "spans")
    discard(members, *done)
    return out


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Spans in order, overlapping and touching ones as one."""
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for s, e in spans:
        kept.append(text[at:s])
        at = e
    kept.append(text[at:])
    return b"".join(kept)


def _with_spans(documents: DataFrame, id_col: str, text_col: str, length: int, cap: int) -> tuple[DataFrame, str]:
    """documents with the spans of their repeats, and the name of that column."""
    spans = repeated_spans(documents, id_col, text_col, length, cap)
    removed, th, key, other = fresh(documents, "removed", "text_hash_", "key_", "other_hash_")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    left = documents.withColumn(th, F.xxhash64(text))
    right = spans.select(F.col("doc_id").alias(key), F.col("th").alias(other), F.col("spans").alias(removed))
    return left.join(right, F.col(id_col).eqNullSafe(F.col(key)) & (F.col(th) == F.col(other)), "left").select(*documents.columns, removed), removed


def remove_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, cap: int = 1024) -> DataFrame:
    """documents with two more columns: kept_bytes (binary, what is left of the text) and removed (array of [s, e) structs).

    A byte goes if a string of `length` bytes over it also starts anywhere else in the corpus, the same text included; strings are
    judged on the input. Texts are UTF-8 bytes and matches never cross texts.

    Defined cases: a null text is empty; texts shorter than length stay whole; repeated rows are repeats of each other, whatever
    their ids, nulls included. An empty table gives no rows. If documents has columns of these names, the new ones get a leading
    underscore.
    """
    joined, removed = _with_spans(documents, id_col, text_col, length, cap)
    (kept,) = fresh(documents, "kept_bytes")
    at = documents.columns.index(text_col)
    span_type = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))

    def cut(batches):
        for b in batches:
            spans = [merged(x) for x in b.column(b.num_columns - 1).to_pylist()]
            left = [without(t or b"", s) for t, s in zip(raw(b.column(at)), spans)]
            new = pa.array([[{"s": s, "e": e} for s, e in x] for x in spans], span_type)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(left, pa.binary()), new], names=[*b.schema.names[:-1], kept, removed])

    pair = T.StructType([T.StructField("s", T.LongType()), T.StructField("e", T.LongType())])
    return mapped(joined, cut, T.StructType([*documents.schema.fields, T.StructField(kept, T.BinaryType()), T.StructField(removed, T.ArrayType(pair))]))


def cut_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, cap: int = 1024) -> DataFrame:
    """documents with what remove_repeats leaves of each text in its place; null texts stay null.

    A character that a cut leaves incomplete goes too. Defined cases are those of remove_repeats: texts shorter than length stay whole, repeated
    rows are repeats of each other, null ids count like any, an empty table gives no rows, and columns may have any names.
    """
    joined, _ = _with_spans(documents, id_col, text_col, length, cap)
    at = documents.columns.index(text_col)

    def put(batches):
        for b in batches:
            spans = map(merged, b.column(b.num_columns - 1).to_pylist())
            new = [None if t is None else without(t, s).decode(errors="ignore") for t, s in zip(raw(b.column(at)), spans)]
            columns = [pa.array(new, pa.string()) if i == at else b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[:-1])

    fields = [T.StructField(f.name, T.StringType()) if i == at else f for i, f in enumerate(documents.schema.fields)]
    return mapped(joined, put, T.StructType(fields))


def op9_suffix_array_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_repeats(docs)
    sizes = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"])
    return out.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), sizes.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))
