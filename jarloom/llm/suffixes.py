"""Substring dedup over bytes by suffix arrays, built by linear grouping of Lyndon prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, back, dropped, hexdigest, mix, read, saved, small, union_length, with_keys
from .repeats import NONE_HOT, Hot, Prefix, asked_of, compared, fetched, run_rows, without

WIDTH, GRAM = 100, 28
SPLIT_ROWS = 2000  # a key with more rows is cut by a second key
BLOCK_BYTES = 8_000  # groups of keys are put in order together up to this
GROUP_BYTES = 1_000_000  # a group with more text is not put in order in one task's memory
LETTERS = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


def suffix_array(s: list[int] | bytes) -> list[int]:
    """The suffixes of s in order, by grouping, in linear time.

    Groups hold suffixes that begin with one and the same known part of their Lyndon prefix; at first, one character. They are taken from the greatest to the smallest.
    When a group is taken its Lyndon prefixes are complete. The previous smaller suffix of each of its members (the nearest one to the left in a smaller group, found by
    going along the pointers of members already taken) has one more child: its own prefix grows by the group's. So these parents leave their groups for new ones just
    above, and a parent of more members of this group comes above one of fewer. Then suffixes of a group differ only in what follows their Lyndon prefix, the next
    smaller suffix: taking suffixes in ascending order, each puts those whose next smaller one it is in the next free places of their groups.
    """
    n = len(s)
    if not n:
        return []
    by: dict[int, list[int]] = {}
    for i, c in enumerate(s):
        if c in by:
            by[c].append(i)
        else:
            by[c] = [i]
    group = [0] * n  # of each suffix
    sizes: list[int] = []  # of each group
    above: list[int] = []  # linked list of groups in order
    below: list[int] = []
    members: list[list[int] | None] = []  # in text order; a suffix that has left is skipped by its group
    for c in sorted(by):
        g = len(sizes)
        for i in by[c]:
            group[i] = g
        sizes.append(len(by[c]))
        members.append(by[c])
        below.append(g - 1)
        above.append(g + 1)
    above[-1] = -1
    previous = [-2] * n  # -2: not yet known, as its group has not been taken; -1: no smaller suffix before it
    g = len(sizes) - 1
    order: list[int] = []  # groups as they are taken
    while g >= 0:
        own = members[g]
        members[g] = None
        order.append(g)
        if len(own) == 1:  # as below, for the most frequent case
            i = own[0]
            if group[i] == g:
                p = i - 1
                while p >= 0 and (q := previous[p]) != -2:
                    p = q
                previous[i] = p
                if p >= 0 and sizes[old := group[p]] > 1:
                    new = len(sizes)
                    sizes[old] -= 1
                    sizes.append(1)
                    members.append([p])
                    group[p] = new
                    up = above[old]
                    above.append(up)
                    below.append(old)
                    above[old] = new
                    if up >= 0:
                        below[up] = new
            g = below[g]
            continue
        own = [i for i in own if group[i] == g]
        for i in own:
            previous[i] = -3  # taken
        counts: dict[int, int] = {}
        for i in own:
            p = i - 1
            while p >= 0 and (q := previous[p]) != -2:
                p = q
            previous[i] = p
            if p >= 0:
                counts[p] = counts.get(p, 0) + 1
        if counts:
            if len(counts) == 1:
                ((p, k),) = counts.items()
                moves = {(group[p], k): [p]}
            else:
                moves = {}
                for p, k in counts.items():
                    at = (group[p], k)
                    if at in moves:
                        moves[at].append(p)
                    else:
                        moves[at] = [p]
            # of one old group, fewer children first: each new group is put just above the one before it
            last: dict[int, int] = {}
            for old, k in sorted(moves) if len(moves) > 1 else moves:
                ps = moves[old, k]
                at = last.get(old, old)
                if len(ps) == sizes[old] and at == old:
                    members[old] = ps if len(ps) == 1 else sorted(ps)
                    continue  # all of it has moved: the group is the new one
                new = len(sizes)
                sizes[old] -= len(ps)
                sizes.append(len(ps))
                members.append(ps if len(ps) == 1 else sorted(ps))
                for p in ps:
                    group[p] = new
                up = above[at]
                above.append(up)
                below.append(at)
                above[at] = new
                if up >= 0:
                    below[up] = new
                last[old] = new
        g = below[g]
    place = [0] * len(sizes)
    at = 0
    for g in reversed(order):
        place[g] = at
        at += sizes[g]
    out = [-1] * n
    p = n - 1
    while p >= 0:  # those that no smaller suffix but the empty one follows
        g = group[p]
        out[place[g]] = p
        place[g] += 1
        p = previous[p]
    for k in range(n):
        i = out[k]
        end, p = previous[i], i - 1
        while p != end:
            g = group[p]
            out[place[g]] = p
            place[g] += 1
            p = previous[p]
    return out


def anchors(raw: np.ndarray, width: int, gram: int, hot: Hot = NONE_HOT) -> tuple[np.ndarray, np.ndarray, Prefix]:
    """For the window at each place, where the leftmost of its least gram hashes stands, hot grams being greater than all others; the gram hashes; hashes of any range."""
    prefix = Prefix(LETTERS[raw])
    g = prefix.windows(gram)
    bits = U64(max(20, len(g).bit_length()))
    v = ((g >> (bits + U64(1))) << bits) | np.arange(len(g), dtype=U64)
    v[hot(g)] |= U64(1 << 63)
    size, want = 1, width - gram + 1
    while 2 * size <= want:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    if want > size:
        v = np.minimum(v[: len(v) - (want - size)], v[want - size :])
    return (v & ((U64(1) << bits) - U64(1))).astype(np.int64), g, prefix


def byte_runs(texts: list[bytes], width: int, gram: int, hot: Hot = NONE_HOT):
    """Runs of windows with one anchor. Equal windows have their anchor at the same place in them, so a run holds no window twice."""
    texts = [t if len(t) >= width else b"" for t in texts]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none.view(U64), none, none, none.view(U64), none
    many = np.array(list(map(len, texts)), np.int64)
    end = np.cumsum(many)
    start = end - many
    at, g, prefix = anchors(raw, width, gram, hot)
    new = np.empty(len(at), bool)
    new[0] = True
    np.not_equal(at[1:], at[:-1], out=new[1:])
    full = np.flatnonzero(many)
    new[start[full]] = True
    stop = np.zeros(len(raw) + 1, bool)  # places where windows end to be valid
    stop[end[full] - width + 1] = True
    first = np.flatnonzero(new | stop[: len(at)])
    last = np.append(first[1:], len(at))
    doc = np.searchsorted(end, first, side="right")
    ok = first <= end[doc] - width
    first, last, doc = first[ok], last[ok], doc[ok]
    n = last - first
    return doc, g[at[first]], first - start[doc], n, prefix.range(first, first + n + width - 1), at[first] - first


def may_repeat(group: list[tuple], width: int, gram: int, steps: int = 4) -> list[tuple]:
    """Rows (..., p, text) of one key that can hold a window which another one holds too.

    A window holds the key's gram, and so one of `steps` stretches around it that are nearly as long as the window: with at least k / steps of what is beside the gram on
    the left, and with what is then left on the right.
    """
    if len(group) < 2:
        return []
    beside, keep = width - gram, [False] * len(group)
    for k in range(steps):
        left = beside * k // steps
        right = beside - beside * (k + 1) // steps
        seen: dict[bytes, int] = {}
        for n, (*_, p, text) in enumerate(group):
            if p >= left and p + gram + right <= len(text):
                other = seen.setdefault(text[p - left : p + gram + right], n)
                if other != n:
                    keep[other] = keep[n] = True
    return [r for r, k in zip(group, keep, strict=True) if k]


def earlier(rows: list[tuple[int, int, int, int, bytes]], width: int) -> Iterator[tuple[int, int, int, int]]:
    """Of texts (d, o, i0, n, ..., text): the stretches (d, o, a, b) covered by windows that also start earlier, by the suffix array of all of them.

    Windows with equal content are neighbours among the windows' suffixes in order; all of a class but the earliest start are repeats. A character that no text has ends
    each text, and only whole windows are looked at, so matches never cross documents.
    """
    rows = sorted(rows, key=lambda r: r[:3])
    s = np.concatenate([np.append(np.frombuffer(r[-1], np.uint8).astype(np.int16) + 1, np.int16(0)) for r in rows])
    length = np.array([len(r[-1]) + 1 for r in rows])
    begin = np.cumsum(length) - length
    text = np.repeat(np.arange(len(rows)), length)
    place = np.arange(len(s)) - begin[text]
    sa = np.array(suffix_array(s.tolist()), np.int64)
    sa = sa[place[sa] < np.array([r[3] for r in rows])[text[sa]]]  # whole windows
    # neighbours in order that agree on the width
    same = np.zeros(len(sa), bool)
    padded = np.lib.stride_tricks.sliding_window_view(np.append(s, np.zeros(width, np.int16)), width)
    for a in range(1, len(sa), 20_000):
        x, y = sa[a - 1 : a + 19_999], sa[a : a + 20_000]
        same[a : a + 20_000] = (padded[x[: len(y)]] == padded[y]).all(1)
    cls = np.cumsum(~same)
    first = np.full(cls[-1] + 1 if len(cls) else 1, len(s))
    np.minimum.at(first, cls, sa)
    gone = np.sort(sa[sa != first[cls]])
    if not len(gone):
        return
    cut = np.flatnonzero((np.diff(gone, prepend=-2) != 1) | (np.diff(text[gone], prepend=-1) != 0))
    for a, e in zip(cut.tolist(), [*cut[1:].tolist(), len(gone)], strict=True):
        t = int(text[gone[a]])
        d, o, i0 = rows[t][:3]
        yield d, o, i0 + int(place[gone[a]]), i0 + int(place[gone[e - 1]]) + width


def repeated_bytes(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, texts: bool = True) -> DataFrame:
    """docs (doc_id, text, ...) to doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if `texts`, kept (the bytes that stay), saved in the shared folder.

    A byte of a text's UTF-8 goes if a `width`-byte string that covers it also starts earlier: in a document of smaller doc_id, or before in the same one. Strings are
    judged on the input, overlaps count, and matches never cross documents.

    Each window is keyed by the least hash of its `gram`-byte grams (leftmost of equals), so equal windows share a key. Under a key, runs of windows that cover equal text
    are settled by a hash of it: all but the earliest go. The different texts under a key are dealt together; those that nearly a whole window is
    in common of (may_repeat()) are put in order, and suffix_array() of them tells which of their windows are equal. A key of more than SPLIT_ROWS texts is cut by the least hash among the other grams of each window, so that a frequent passage does not fill one task. A
    group that still has over GROUP_BYTES of text is compared window by window in Spark, which spills, so no task holds more than that.

    A null text is empty. Rows that share a doc_id stand in the order in which they are read. A null doc_id comes before all others and is returned as
    null. Empty tables give no rows. A group of copies costs in proportion to its size. Other columns are not read.
    """
    d = with_keys(docs)
    x = compared(run_rows(d, lambda texts, hot: byte_runs(texts, width, gram, hot), every=False), "suf-rows")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            for k in range(b.num_rows):
                text = b.column(2)[k].as_py().encode()
                for at in range(0, len(b.column(3)[k]), 5000):  # a long document has many
                    yield rows_of(b.column(0)[k].as_py(), b.column(1)[k].as_py(), text, asked_of(b.column(3)[k], at, 5000))

    def rows_of(d: int, o: int, text: bytes, asked: dict) -> pa.RecordBatch:
        rows = []
        for key, i0, n, p, many in zip(*(asked[c].tolist() for c in ("key", "i0", "n", "p", "rows")), strict=True):
            part = text[i0 : i0 + n + width - 1]
            if many <= SPLIT_ROWS:
                rows.append((key, 0, i0, n, p, part))
                continue
            g = Prefix(LETTERS[np.frombuffer(part, np.uint8)]).windows(gram)
            g[g == np.int64(key).astype(U64)] = U64(2**64 - 1)
            sub = np.lib.stride_tricks.sliding_window_view(g, width - gram + 1).min(1)
            first = np.flatnonzero(np.append(True, sub[1:] != sub[:-1]))
            rows += [(key, int(sub[a].view(np.int64)), i0 + a, e - a, p - a, part[a : e + width - 1]) for a, e in zip(first.tolist(), [*first[1:].tolist(), len(sub)], strict=True)]
        keys, subs, i0, n, p, parts = zip(*rows, strict=True)
        m = len(rows)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(subs, pa.int64()), pa.array([d] * m, pa.int64()), pa.array([o] * m, pa.int64()), pa.array(i0, pa.int32()), pa.array(n, pa.int32()), pa.array(p, pa.int32()), pa.array(parts, pa.binary())], ["key", "sub", "_d", "_o", "i0", "n", "p", "text"])

    def parts_of(rows: DataFrame) -> DataFrame:
        asked = fetched(d, rows, ["key", "i0", "n", "p", "rows"])
        out = asked.mapInArrow(cut_out, "key long, sub long, _d long, _o long, i0 int, n int, p int, text binary")
        return out.withColumn("bucket", F.xxhash64("key", "sub"))

    # a key of at most SPLIT_ROWS runs has less text than GROUP_BYTES; only the others are looked at for that
    apart = x.filter("mixed and first")
    rest, over, tables = parts_of(apart.filter(F.col("rows") <= SPLIT_ROWS)), None, []
    many = apart.filter(F.col("rows") > SPLIT_ROWS)
    if not many.isEmpty():
        parts = saved(parts_of(many), "suf-parts", rows=512)
        large = saved(parts.groupBy("bucket").agg(F.sum(F.length("text")).alias("s")).filter(F.col("s") > GROUP_BYTES).select("bucket"), "suf-large")
        tables = [parts, large]
        if large.isEmpty():
            rest = rest.unionByName(parts)
        else:
            rest, over = rest.unionByName(parts.join(large, "bucket", "left_anti").select(*parts.columns)), parts.join(large, "bucket", "left_semi")

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups come sorted; some whole ones are put in order together. Equal windows have equal keys, so what stands beside a group does not matter."""
        held: list[tuple] = []
        group: list[tuple] = []
        now, size = None, 0

        def done() -> pa.RecordBatch:
            got = list(earlier(held, width))
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in got], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["_d", "_o", "a", "b"])

        for b in batches:
            for key, *row in zip(*(b.column(k).to_pylist() for k in range(7)), strict=True):
                if key != now:
                    some = may_repeat(group, width, gram)
                    held += some
                    size += sum(len(r[-1]) for r in some)
                    now, group = key, []
                    if size > BLOCK_BYTES:
                        yield done()
                        held, size = [], 0
                group.append(tuple(row))
        held += may_repeat(group, width, gram)
        if held:
            yield done()

    shared = rest.select("bucket", "_d", "_o", "i0", "n", "p", "text").repartition("bucket").sortWithinPartitions("bucket")
    each = shared.mapInArrow(order, "_d long, _o long, a int, b int")
    if over is not None:  # window by window: Spark adds up and spills
        window = over.select("_d", "_o", "i0", "text", F.explode(F.expr("sequence(0, n - 1)")).alias("j")).select("_d", "_o", (F.col("i0") + F.col("j")).alias("a"), F.expr(f"substring(text, j + 1, {width})").alias("w"))
        window = saved(window, "suf-windows")
        least = window.groupBy("w").agg(F.min(F.struct("_d", "_o", "a")).alias("least"))
        later = window.join(least, "w").filter(F.struct("_d", "_o", "a") != F.col("least"))
        each = each.unionByName(later.select("_d", "_o", "a", (F.col("a") + width).alias("b")))
    gone = x.filter("key is null or (same and not first)").select("_d", "_o", F.col("i0").alias("a"), (F.col("i0") + F.col("n") + (width - 1)).alias("b")).unionByName(each)
    gone = saved(gone, "suf-gone", rows=2000)
    dropped(x, *tables, *([] if over is None else [window]))

    def cut(text: bytes, a: np.ndarray, b: np.ndarray) -> tuple:
        out = union_length(a, b, len(text)) if len(a) else np.zeros(0, bool)
        kept = np.frombuffer(text, np.uint8)[~out].tobytes() if len(a) else text
        return len(text), int(out.sum()), int((np.diff(out.astype(np.int8), prepend=0) == 1).sum()), hexdigest(kept), *([kept] if texts else [])

    return back(without(d, gone, cut, "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(read(spark, sf_dir, "documents"), texts=False)
