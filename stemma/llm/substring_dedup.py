"""Exact removal of repeated 100-byte strings by a sparse, distributed suffix array.

Every string of LENGTH bytes holds an anchor, the least hashed gram of GRAM bytes in it, which depends on the string's
bytes alone (winnowing); all strings with one anchor start in one range. So only suffixes at anchors are looked at:

1. Anchors of a run of documents are folded: of equal neighbourhoods (all bytes of an anchor's strings) the first
   stays, the others repeat it whole. A gram goes to its partition once for each run, however often it occurs.
   Grams met once are done with; those met with one neighbourhood leave its first and mark the others.
2. The rest, grams met with different neighbourhoods, is folded over all runs. What stays are distinct suffixes.
3. Their texts are sorted in runs, front-coded (the common prefix with the one before is a number) and exchanged;
   a loser tree merges a partition's runs by common-prefix lengths, and compares bytes past known prefixes only.
   The merged order brings the suffixes of a gram together, with their common prefixes; a string at offset o before
   the anchor can repeat only if a neighbour shares LENGTH - o bytes with it. Those are compared in (document, start)
   order. Grams with more suffixes than GROUP are hot: their strings are compared by 128-bit digests, dealt out by
   digest, so no task holds a gram's suffixes.

Marked starts of each document then give its removed bytes. Null texts count as empty. Texts shorter than LENGTH are
kept whole. Rows without doc_id come first; rows that share a doc_id, or have none, are documents of their own in the
order of a digest of their texts. Rows that repeat one whole are the same document. An empty table gives no rows.
Long texts are worked on in pieces of PIECE bytes, and partitions follow the number of bytes, so no task's memory grows
with a text or with the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm.common import byte_view, documents, release, row_keys, saved, slices

LENGTH, GRAM = 100, 32
GROUP = 2048
RUN_ANCHORS = 400_000
#: Bytes of a text that are looked at together; suffixes sorted together; bytes of text for each partition of an exchange.
PIECE, RUN_SUFFIXES, PART_BYTES = 1 << 20, 100_000, 1 << 24
G, G_MANY, C, M, FIRST, SUFFIXES, STRING = range(7)
#: key and e: two digests; p: start << 32 | number of starts (marks), or start << 32 | offset of the anchor << 16 | starts.
ROW = "kind tinyint, key bigint, e bigint, doc bigint, p bigint"

_rng = np.random.Generator(np.random.PCG64(5))
_TABLES = _rng.integers(0, 1 << 63, (3, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers_of(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 21)
        up = np.full(size, _BASES[which], np.uint64)
        down = np.full(size, pow(_BASES[which], -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = _powers[which] = (np.cumprod(up), np.cumprod(down))
    return have


class Digests:
    """Digest of data[a:b] for arrays a, b in constant time each."""

    def __init__(self, which: int, data: np.ndarray):
        up, self.down = _powers_of(which, len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLES[which][data] * up[: len(data)], out=self.prefix[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mix((self.prefix[b] - self.prefix[a]) * self.down[a])


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """gram, neighbourhood digest, text number, start, offset of the anchor, starts; for all anchors of all texts."""
    lengths = np.diff(offsets)
    n_starts = np.maximum(0, lengths - LENGTH + 1)
    if not n_starts.sum():
        return (np.empty(0, np.uint64), np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(4)))
    grams, width = Digests(0, data), LENGTH - GRAM + 1
    at = np.arange(len(data) - GRAM + 1)
    h = grams.of(at, at + GRAM)
    bits = np.uint64(max(20, len(data).bit_length()))
    least = (h >> bits << bits) | at.astype(np.uint64)  # the place breaks ties: the leftmost
    span = 1
    while span * 2 <= width:
        least, span = np.minimum(least[:-span], least[span:]), span * 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    doc = np.repeat(np.arange(len(lengths)), n_starts)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(n_starts) - n_starts, n_starts) + offsets[:-1][doc]
    anchor = (least[start] & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]))
    a, x, doc = start[first], anchor[first], doc[first]
    n = np.diff(np.concatenate([first, [len(start)]]))
    e = _mix(Digests(1, data).of(a, a + n - 1 + LENGTH) + ((x - a) * 256 + n).astype(np.uint64))
    return h[x], e, doc, a - offsets[:-1][doc], x - a, n


def _batch(kind, key, e, doc, p) -> pa.RecordBatch:
    long = lambda v: pa.array(np.ascontiguousarray(v).view(np.int64) if v.dtype == np.uint64 else v.astype(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(np.int8(kind), len(doc)) if np.isscalar(kind) else kind.astype(np.int8)), long(key), long(e), long(doc), long(p)], names=["kind", "key", "e", "doc", "p"])


def _marks(doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Marks of starts, neighbouring ones joined; their keys are spread for the exchange."""
    if len(doc):
        o = np.lexsort([start, doc])
        doc, start, n = doc[o], start[o], n[o]
        new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] != (start + n)[:-1])]))
        n = np.add.reduceat(n, new)
        doc, start = doc[new], start[new]
    key = _mix(doc.astype(np.uint64) * np.uint64(31) + start.astype(np.uint64))
    return _batch(M, key, np.zeros(len(doc), np.int64), doc, start << 32 | n)


def _groups(*keys: np.ndarray) -> np.ndarray:
    new = np.zeros(len(keys[0]), bool)
    if len(new):
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return new


def _later(new: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Rows that repeat their group's first row at another place."""
    lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(new) else np.empty(0, int)
    return ~new & ((doc != doc[lead]) | (start != start[lead]))


def _folded(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """A run's rows: each gram once, neighbourhoods of grams that have several, marks of repeats."""
    g, e, doc, start, off, n = (np.concatenate(c) for c in zip(*parts))
    o = np.lexsort([start, doc, e, g])
    g, e, doc, start, off, n = (c[o] for c in (g, e, doc, start, off, n))
    new_g, new_e = _groups(g), _groups(g, e)
    later = _later(new_e, doc, start)
    yield _marks(doc[later], start[later], n[later])
    many = np.bincount(np.cumsum(new_g) - 1, new_e)[np.cumsum(new_g) - 1] > 1
    p = start << 32 | off << 16 | n
    yield _batch(np.where(many[new_g], G_MANY, G), g[new_g], e[new_g], doc[new_g], p[new_g])
    several = new_e & many
    yield _batch(C, e[several], g[several], doc[several], p[several])


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, held = [], 0
    for whole in batches:
        for batch in slices(whole, limit=PIECE):
            data, offsets = byte_view(batch.column("text"))
            # a piece has all bytes of the strings that start in it
            pieces = [(0, data, offsets)] if batch.num_rows > 1 else [(a, x := data[a : a + PIECE + LENGTH - 1], np.array([0, len(x)])) for a in range(0, len(data), PIECE)]
            for a, data, offsets in pieces:
                g, e, doc, start, off, n = anchors(data, offsets)
                parts.append((g, e, batch.column("doc").to_numpy()[doc], start + a, off, n))
                held += len(g)
                if held >= RUN_ANCHORS:
                    yield from _folded(parts)
                    parts, held = [], 0
    if held:
        yield from _folded(parts)


def _gathered(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, ...] | None:
    """All rows of a partition as arrays; rows are dealt out by digest, so partitions are even."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return None
    t = pa.Table.from_batches(got)
    return tuple(t.column(c).to_numpy() for c in ("kind", "key", "e", "doc", "p"))


def _by_gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = _gathered(batches)
    if rows is None:
        return
    kind, key, e, doc, p = rows
    rest = kind >= C
    yield _batch(kind[rest], key[rest], e[rest], doc[rest], p[rest])
    kind, key, e, doc, p = (c[~rest] for c in rows)
    o = np.lexsort([p, doc, key])
    kind, key, e, doc, p = (c[o] for c in (kind, key, e, doc, p))
    new = _groups(key)
    group = np.cumsum(new) - 1
    if not len(new):
        return
    at = np.flatnonzero(new)
    mixed = ((np.minimum.reduceat(e, at) != np.maximum.reduceat(e, at)) | (np.maximum.reduceat(kind, at) == G_MANY))[group]
    later = _later(new, doc, p >> 32) & ~mixed
    yield _marks(doc[later], p[later] >> 32, p[later] & 0xFFFF)
    several = mixed & (kind == G)
    yield _batch(C, e[several], key[several], doc[several], p[several])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows with equal (key, e) the first stays (kind FIRST), the others become marks."""
    rows = _gathered(batches)
    if rows is None:
        return
    _, key, e, doc, p = rows
    o = np.lexsort([p, doc, e, key])
    key, e, doc, p = (c[o] for c in (key, e, doc, p))
    new = _groups(key, e)
    later = _later(new, doc, p >> 32)
    yield _marks(doc[later], p[later] >> 32, p[later] & 0xFFFF)
    yield _batch(FIRST, key[new], e[new], doc[new], p[new])


Suffix = tuple[bytes, bytes, int, int]  # from the anchor on, before it, document, p


def front_coded(run: list[Suffix]) -> bytes:
    """A sorted run: for each suffix the common prefix with the one before, the rest's length and the rest, then its satellites."""
    out, before = [], b""
    for s, left, doc, p in run:
        lcp = common_prefix(before, s, 0)
        out.append(bytes((lcp, len(s) - lcp, len(left))) + s[lcp:] + left + doc.to_bytes(8, "little", signed=True) + p.to_bytes(8, "little"))
        before = s
    return b"".join(out)


def decoded(blob: bytes) -> Iterator[tuple[int, Suffix]]:
    at, before = 0, b""
    while at < len(blob):
        lcp, rest, left = blob[at : at + 3]
        a = at + 3
        b, c = a + rest, a + rest + left
        before = before[:lcp] + blob[a:b]
        yield lcp, (before, blob[b:c], int.from_bytes(blob[c : c + 8], "little", signed=True), int.from_bytes(blob[c + 8 : c + 16], "little"))
        at = c + 16


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which `known` bytes need no look."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    step = 8
    while a[known : known + step] == b[known : known + step]:
        known += step
    while a[known] == b[known]:
        known += 1
    return known


def merged(runs: list[Iterator[tuple[int, Suffix]]]) -> Iterator[tuple[int, Suffix]]:
    """Merge sorted runs with a loser tree; yields the common prefix with the one before, and the suffix.

    Each waiting suffix knows its common prefix with the last winner of its path. The longer one is the smaller; only
    at a tie are bytes compared, from the known prefix on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    head: list[Suffix | None] = [None] * k
    lcp = [-1] * k
    for i, r in enumerate(runs):
        got = next(r, None)
        if got is not None:
            lcp[i], head[i] = 0, got[1]

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        x, y = lcp[a], lcp[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x < 0:
            return a, b
        s, t = head[a][0], head[b][0]
        same = common_prefix(s, t, x)
        if same == len(s) or (same < len(t) and s[same] < t[same]):
            lcp[b] = same
            return a, b
        lcp[a] = same
        return b, a

    loser = [0] * k
    winners = list(range(k))
    width = k
    while width > 1:
        width //= 2
        nxt = []
        for i in range(width):
            w, lost = play(winners[2 * i], winners[2 * i + 1])
            loser[width + i] = lost
            nxt.append(w)
        winners = nxt
    top = winners[0]
    while lcp[top] >= 0:
        yield lcp[top], head[top]
        got = next(runs[top], None)
        if got is None:
            lcp[top], head[top] = -1, None
        else:
            lcp[top], head[top] = got
        node = (top + k) // 2
        while node:
            top, loser[node] = play(top, loser[node])
            node //= 2


def repeats(group: list[tuple[int, Suffix]]) -> Iterator[tuple[int, int, int]]:
    """(document, start, 1) of strings in a gram's suffixes that an earlier one has too; common prefixes are with the one before."""
    n = len(group)
    order = sorted(range(n), key=lambda i: (group[i][1][2], group[i][1][3]))
    seen: dict[tuple[int, bytes], tuple[int, int]] = {}
    for i in order:
        s, left, doc, p = group[i][1]
        reach = max(group[i][0] if i else 0, group[i + 1][0] if i + 1 < n else 0)
        start, off, starts = p >> 32, p >> 16 & 0xFFFF, p & 0xFFFF
        whole = left + s
        for k in range(min(starts, off - (LENGTH - reach) + 1)):
            mine = (doc, start + k)
            if seen.setdefault((off - k, whole[k : k + LENGTH]), mine) != mine:
                yield doc, start + k, 1


def _suffix_rows(parts: int):
    """Sorted front-coded runs of each slice, by partition; strings of hot grams by digest."""

    def sorted_runs(runs: dict[int, list[Suffix]]) -> Iterator[pa.RecordBatch]:
        for part, r in runs.items():
            r.sort()
            yield _exchange([SUFFIXES], [part], [front_coded(r)], [0], [0], [0], [0])

    def hot_strings(data: np.ndarray, at: np.ndarray, n: np.ndarray, doc: np.ndarray, start: np.ndarray) -> Iterator[pa.RecordBatch]:
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at, doc, start = np.repeat(at, n) + step, np.repeat(doc, n), np.repeat(start, n) + step
        d1, d2 = (Digests(w, data).of(at, at + LENGTH).view(np.int64) for w in (1, 2))
        o = np.lexsort([start, doc, d2, d1])
        d1, d2, doc, start = (c[o] for c in (d1, d2, doc, start))
        new = _groups(d1, d2)
        later = _later(new, doc, start)
        m = int(later.sum())
        yield _exchange([M] * m, [0] * m, [None] * m, [0] * m, [0] * m, doc[later], start[later] << 32 | 1)
        m = int(new.sum())
        yield _exchange([STRING] * m, [0] * m, [None] * m, d1[new], d2[new], doc[new], start[new] << 32 | 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, limit=PIECE):
                data, offsets = byte_view(batch.column("text"))
                found = batch.column("found")
                count, flat = found.value_lengths().to_numpy(), found.flatten()
                p, gram, hot = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                doc = np.repeat(batch.column("doc").to_numpy(), count)
                start, off, n = p >> 32, p >> 16 & 0xFFFF, p & 0xFFFF
                a = np.repeat(offsets[:-1], count) + start
                o = np.argsort(a, kind="stable")
                for at in range(0, len(o), RUN_SUFFIXES):
                    runs: dict[int, list[Suffix]] = {}
                    own = o[at : at + RUN_SUFFIXES]
                    own = own[~hot[own]]
                    for x, b, m, d, q, part in zip(a[own].tolist(), off[own].tolist(), n[own].tolist(), doc[own].tolist(), p[own].tolist(), (gram[own] % parts).tolist()):
                        whole_string = data[x : x + m - 1 + LENGTH].tobytes()
                        runs.setdefault(part, []).append((whole_string[b:], whole_string[:b], d, q))
                    yield from sorted_runs(runs)
                o = o[hot[o]]
                for piece in np.split(o, np.flatnonzero(np.diff(a[o] // PIECE)) + 1):
                    if len(piece):
                        low = int(a[piece[0]])
                        yield from hot_strings(data[low : int(a[piece[-1]]) + 256 + LENGTH], a[piece] - low, n[piece], doc[piece], start[piece])

    return run


EXCHANGE = "kind tinyint, part int, blob binary, key bigint, e bigint, doc bigint, p bigint"


def _exchange(kind, part, blob, key, e, doc, p) -> pa.RecordBatch:
    kinds = [pa.int8(), pa.int32(), pa.binary(), *[pa.int64()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((kind, part, blob, key, e, doc, p), kinds)], names=[c.split()[0] for c in EXCHANGE.split(", ")])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the runs of each part in this task, and mark repeats gram by gram."""
    runs: dict[int, list[bytes]] = {}
    for b in batches:
        for part, blob in zip(b.column("part").to_pylist(), b.column("blob").to_pylist()):
            runs.setdefault(part, []).append(blob)
    for part in sorted(runs):
        found: list[tuple[int, int, int]] = []
        group: list[tuple[int, Suffix]] = []
        for lcp, s in merged([decoded(b) for b in runs.pop(part)]):
            if lcp < GRAM:
                if len(group) > 1:
                    found.extend(repeats(group))
                group = []
            group.append((lcp, s))
        if len(group) > 1:
            found.extend(repeats(group))
        if found:
            yield _marks(*np.array(found, np.int64).T)


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole):
            data, offsets = byte_view(batch.column("text"))
            rows = []
            for base, end, marks in zip(offsets[:-1].tolist(), offsets[1:].tolist(), batch.column("marks")):
                gone = []
                if marks.is_valid:
                    m = np.sort(marks.values.to_numpy(zero_copy_only=False))
                    a, b = m >> 32, np.maximum.accumulate((m >> 32) + (m & 0xFFFFFFFF) - 1 + LENGTH)
                    new = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
                    gone = list(zip(a[new].tolist(), b[np.append(new[1:], len(a)) - 1].tolist()))
                raw = data[base:end]
                kept = b"".join([raw[x:y].tobytes() for x, y in zip([0, *[y for _, y in gone]], [*[x for x, _ in gone], end - base])])
                rows.append((end - base, end - base - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept))
            n, r, s, h, k = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(s, pa.int64()), pa.array(h, pa.string()), pa.array(k, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )


def repeated_marks(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """(doc, p) for all strings of docs(doc, text) that occur earlier: p is start << 32 | number of starts."""
    spark = docs.sparkSession
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_bytes // PART_BYTES)
    rows = docs.select("doc", "text").mapInArrow(_anchor_rows, ROW)
    first = saved(rows.repartition(dealt, "key").mapInArrow(_by_gram, ROW), "grams")
    release(spark)
    second = saved(first.where(f"kind = {C}").repartition(dealt, "key").mapInArrow(_fold, ROW), "suffixes")
    release(spark)
    ends = second.where(f"kind = {FIRST}").select(F.col("e").alias("gram"), "doc", "p")
    hot = ends.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > group).select("gram", F.lit(True).alias("hot"))
    wanted = ends.join(hot, "gram", "left").groupBy("doc").agg(F.collect_set(F.struct("p", "gram", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("found"))
    parts = 4 * dealt
    sent = docs.join(wanted, "doc").select("doc", "text", "found").mapInArrow(_suffix_rows(parts), EXCHANGE)
    sent = saved(sent, "runs")
    release(spark)
    merge = sent.where(f"kind = {SUFFIXES}").select("part", "blob").repartition(dealt, "part").mapInArrow(_merge, ROW)
    strings = sent.where(f"kind = {STRING}").select("kind", "key", "e", "doc", "p").repartition(dealt, "key").mapInArrow(_fold, ROW)
    tables = [first, second, saved(merge, "merged"), sent, strings]
    out = None
    for t in tables:
        m = t.where(f"kind = {M}").select("doc", "p")
        out = m if out is None else out.unionByName(m)
    return out


def numbered(docs: DataFrame) -> DataFrame:
    """doc, doc_id, text for each row of docs: doc is the doc_id, or, if doc_ids do not tell texts apart, a number in their order."""
    k1, k2 = row_keys()
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumns({"k1": k1, "k2": k2})
    per_id = keyed.groupBy("doc_id").agg(F.min("k2").alias("a"), F.max("k2").alias("b"))
    if per_id.where("a <> b or doc_id is null").isEmpty():
        return keyed.select(F.col("doc_id").alias("doc"), "doc_id", "text")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("k2")]
    ranged = keyed.select("doc_id", "k1", "k2").distinct().repartitionByRange(n, *order).sortWithinPartitions(*order)
    numbers = saved(ranged.select("k1", "k2", F.monotonically_increasing_id().alias("doc")), "numbers")
    return saved(keyed.join(numbers, ["k1", "k2"]).select("doc", "doc_id", "text"), "numbered")


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (bytes) for each row of docs(doc_id, text)."""
    keyed = numbered(docs)
    marks = saved(repeated_marks(keyed).groupBy("doc").agg(F.collect_set("p").alias("marks")), "marks")
    release(docs.sparkSession)
    out = keyed.join(marks, "doc", "left").select("doc_id", "text", "marks")
    return out.mapInArrow(_cleaned, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(documents(spark, sf_dir)).drop("kept")
