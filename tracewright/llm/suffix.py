"""Exact removal of repeated 100-byte strings with suffix arrays that are built by linear grouping.

A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a smaller document, or further left in
the same one. To sort only suffixes that can match, every string of LENGTH bytes is sent to the smallest GRAM-byte hash
inside it (its anchor), which equal strings share, at the same place. Neighbouring strings with one anchor travel
together as a context. An anchor that occurs once has nothing to sort.

A string starts 0 to 68 bytes left of its anchor. Starts are dealt to CLASSES by that distance; all strings of a class hold the
same 78 bytes around the anchor, and equal strings are in one class. A context carries a short hash of these bytes
for each class it has strings in. Where no other text of the anchor has a class's hash, none has its strings, and the text is
sorted without them; a hash only lets strings go that differ for certain.

Contexts of one anchor that are the same text enter as one text, its earliest place. A hash brings them together; that
they are the same is then checked on the bytes: a copy's neighbouring contexts that follow the same source are joined to
pieces, and each piece's bytes are compared with its source's by a join. A difference stops the job: no hash decides.

The different texts of an anchor are joined to one, whose suffix array is built by grouping: suffixes are put in
groups by their Lyndon prefix, the groups are taken from the largest down, and each moves the suffixes that its
previous-smaller pointers name into finer groups; one more pass from the smallest suffix up emits the order inside the
groups, without renaming and recursion. Suffixes that agree on LENGTH bytes are then neighbours, and all but the earliest of
them are repeats. Many texts are sorted side by side with array operations.

An anchor with very many different texts is parted by more of its strings' bytes: a string holds either the next bytes
left of the anchor or those right of it, so each text gives a left and a right part, named by those bytes; parts that are
still too many are parted again, up to whole strings. Parts that became the same bytes go on as one, the earliest. Sorting means
the same in each part, and no group grows with the input.

Defined cases: a null or empty text has no bytes; texts are never joined, so matches stay inside documents; rows that
share a doc_id, or have none, are documents in the order of doc_id (null first) and then text; equal rows that share
a doc_id count as one document and get the same result; an empty table gives no rows; extra columns never clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices
from .components import numbered

LENGTH, GRAM = 100, 32
#: Bytes of text whose hashes are taken at a time, as arrays that stay in a core's cache; positions inside fit PLACE bits.
BLOCK, PLACE = 1 << 17, 22
#: Bytes of text that a task holds at a time otherwise.
SLICE = 1 << 21
#: Classes of strings by their anchor's place in them, and distances in each.
CLASSES, STEP = 3, 23
#: Contexts among which a task spots repeats without a shuffle.
TOGETHER_CONTEXTS = 1 << 17
#: Different texts of an anchor that are sorted together, and bytes of texts sorted side by side.
MANY, TOGETHER = 48, 1 << 19
#: A piece of a copy stays inside one such stretch of its source, so a source has few different pieces.
STRETCH = 1 << 12

U = np.uint64
ODD = U(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * ODD)


def _power(base: int, n: int) -> U:
    return U(pow(base, n, 1 << 64))


def _rolling(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` (a power of two) bytes from each place on."""
    h, n = BYTE[data], 1
    while n < size:
        h = h[:-n] * _power(0xD6E8FEB86659FD93, n) + h[n:]
        n *= 2
    return _mix(h)


#: Powers of an odd base and of its inverse, for hashes of any stretch of a block.
BASE = 0xF1357AEA2E62A9C5


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p, k = np.ones(n, np.uint64), 1
        while k < n:
            m = min(k, n - k)
            p[k : k + m] = p[:m] * _power(base, k)
            k *= 2
        out.append(p)
    return out[0], out[1]


class Stretches:
    """Hashes of stretches [a, e) of a text, from sums of its bytes times powers."""

    powers = _powers(BLOCK * 2 + 2)

    def __init__(self, data: np.ndarray):
        up, self.down = self.powers if len(data) < len(self.powers[0]) else _powers(len(data) + 2)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE[data] * up[: len(data)], out=self.sums[1:])

    def hash(self, a: np.ndarray, e: np.ndarray) -> np.ndarray:
        return _mix((self.sums[e] - self.sums[a]) * self.down[a] + (e - a).astype(np.uint64) * ODD)


def anchors(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """The contexts of a block of documents that begin at `starts`: document, place of the anchor, first and last start
    of its strings, hash of the anchor, hash of the context, and its shape."""
    n, width = len(data) - LENGTH + 1, LENGTH - GRAM + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none, none, none, none
    grams = _rolling(data, GRAM)
    best = (grams & ~U((1 << PLACE) - 1)) | np.arange(len(grams), dtype=np.uint64)
    k = 1
    while 2 * k <= width:
        best = np.minimum(best[:-k], best[k:])
        k *= 2
    if k < width:
        best = np.minimum(best[: len(best) - (width - k)], best[width - k :])
    at = (best & U((1 << PLACE) - 1)).astype(np.int64)
    place = np.arange(n)
    ends = np.append(starts[1:], len(data))
    inside = np.zeros(n + 1, np.int8)
    long = ends - starts >= LENGTH
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - LENGTH + 1, -1)
    fine = np.cumsum(inside[:n]) > 0
    first = fine & np.append(True, (at[1:] != at[:-1]) | ~fine[:-1])
    last = fine & np.append((at[1:] != at[:-1]) | ~fine[1:], True)
    begin = np.zeros(n, bool)
    begin[starts[long]] = True
    first |= begin & fine
    last[:-1] |= begin[1:] & fine[:-1]
    a, b = place[first], place[last]
    p = at[a]
    doc = np.searchsorted(starts, a, side="right") - 1
    name = grams[p]
    stretches = Stretches(data)
    context = stretches.hash(a, b + LENGTH) + (p - a).astype(np.uint64) * ODD
    return doc, p, a, b, name.view(np.int64), context.view(np.int64), _shape(stretches, p, a, b)


def _shape(stretches: Stretches, p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of a context's first and last start from its anchor, 7 bits each, and for each class in which it has
    strings 16 bits of the hash of the bytes that all strings of that class hold."""
    first, last = p - a, p - b
    shape = (first | last << 7).astype(np.uint64)
    for c in range(CLASSES):
        k = np.flatnonzero((last < (c + 1) * STEP) & (first >= c * STEP))
        h = stretches.hash(p[k] - c * STEP, p[k] - (c + 1) * STEP + 1 + LENGTH)
        shape[k] |= (h >> U(48)) << U(14 + 16 * c)
    return shape.view(np.int64)


def _span(shape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return shape & 127, shape >> 7 & 127


CONTEXTS = "anchor long, context long, doc_id long, place long, shape long, of_doc long, of_place long"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Documents joined to blocks: bytes, starts, ids, and where each starts in its document. A longer document comes in pieces that
    overlap by LENGTH - 1."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def close():
        sizes = [len(x) for _, _, x in held]
        return np.frombuffer(b"".join(x for _, _, x in held), np.uint8), np.cumsum([0, *sizes[:-1]]), np.array([i for i, _, _ in held], np.int64), np.array([o for _, o, _ in held], np.int64)

    for b in slices(batches, "text", BLOCK):
        for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            for o in range(0, max(len(t) - LENGTH + 1, 0), BLOCK):
                piece = t[o : o + BLOCK + LENGTH - 1]
                if held and size + len(piece) > BLOCK:
                    yield close()
                    held, size = [], 0
                held.append((i, o, piece))
                size += len(piece)
    if held:
        yield close()


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All contexts; those of which the task holds an earlier one come with anchor null and with its place."""
    held: list[tuple[np.ndarray, ...]] = []
    n = 0

    def close() -> pa.RecordBatch:
        name, context, own, place, shape = (np.concatenate(c) for c in zip(*held, strict=True))
        by = np.argsort(own, kind="stable")  # places of a document ascend already
        name, context, own, place, shape = (c[by] for c in (name, context, own, place, shape))
        order = np.argsort(context)
        new = np.append(True, (context[order][1:] != context[order][:-1]) | (name[order][1:] != name[order][:-1]))
        source = np.empty(len(order), np.int64)
        source[order] = np.minimum.reduceat(order, np.flatnonzero(new))[np.cumsum(new) - 1]
        repeat = source != np.arange(len(order))
        columns = [pa.array(name, mask=repeat), pa.array(np.where(repeat, own, context)), *map(pa.array, (own, place, shape))]
        columns += [pa.array(own[source], mask=~repeat), pa.array(place[source], mask=~repeat)]
        return pa.RecordBatch.from_arrays(columns, ["anchor", "context", "doc_id", "place", "shape", "of_doc", "of_place"])

    for data, starts, ids, offsets in _blocks(batches):
        doc, p, _, _, name, context, shape = anchors(data, starts)
        if len(doc):
            held.append((name, context, ids[doc], p - starts[doc] + offsets[doc], shape))
            n += len(doc)
            if n > TOGETHER_CONTEXTS:
                yield close()
                held, n = [], 0
    if held:
        yield close()


SETTLED = "doc_id long, begin long, stop long, anchor long, at int, of_doc long, of_begin long"


def _shared(group: np.ndarray, shape: np.ndarray, every: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last start (distances from the anchor) of what different texts of an anchor may share with another one;
    first < last: nothing. Where `every` is set the whole text counts, as texts that it shares with may not be among these."""
    first, last = _span(shape)
    upper, lower = np.full(len(shape), -1), np.full(len(shape), LENGTH)
    for c in range(CLASSES):
        k = np.flatnonzero((last < (c + 1) * STEP) & (first >= c * STEP))
        name = group[k] << 16 | shape[k] >> (14 + 16 * c) & 0xFFFF
        order = np.argsort(name, kind="stable")
        new = np.ones(len(k) + 1, bool)
        new[1:-1] = name[order][1:] != name[order][:-1]
        k = k[order[~(new[1:] & new[:-1])]]
        upper[k] = (c + 1) * STEP - 1
        lower[k] = np.minimum(lower[k], c * STEP)
    return np.where(every, first, np.minimum(first, upper)), np.where(every, last, np.maximum(last, lower))


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From contexts sorted by anchor, context, document and place: those that look like an earlier one, with its place
    (anchor null), and the first of each text of an anchor that has several, cut to what it may share with the others. Memory stays
    bounded whatever an anchor has."""
    names = [c.split()[0] for c in SETTLED.split(", ")]
    carry: pa.Table | None = None
    going: tuple[int, int, int, int] | None = None  # anchor, context and first place before carry, if that anchor is known to have several

    def decide(t: pa.Table, whole: bool = True) -> tuple[pa.RecordBatch, tuple[int, int, int, int]]:
        name, context, own, place, shape = (t.column(c).to_numpy() for c in ("anchor", "context", "doc_id", "place", "shape"))
        first, last = _span(shape)
        begin = place - first
        new = np.append(True, name[1:] != name[:-1])
        head = new | np.append(True, context[1:] != context[:-1])
        group = np.cumsum(new) - 1
        several = np.bincount(group, weights=head)[group] > 1
        before = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
        of_doc, of_begin = own[before], begin[before]
        if going and name[0] == going[0]:
            several[group == 0] = True
            if context[0] == going[1]:
                head[0] = False
                same = before == 0
                of_doc, of_begin = np.where(same, going[2], of_doc), np.where(same, going[3], of_begin)
        k = np.flatnonzero(head & several)
        more = np.full(len(k), not whole) if not (going and name[0] == going[0]) else (group[k] == 0) | (not whole)
        first[k], last[k] = _shared(group[k], shape[k], more)
        take = ~head
        take[k] = first[k] >= last[k]
        begin = place - first
        columns = [own[take], begin[take], (place - last + LENGTH)[take], pa.array(name[take], mask=~head[take]), first[take].astype(np.int32), pa.array(of_doc[take], mask=head[take]), pa.array(of_begin[take], mask=head[take])]
        state = int(name[-1]), int(context[-1]), int(of_doc[-1]), int(of_begin[-1])
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names), state

    for b in batches:
        done = pa.compute.is_null(b.column("anchor"))
        local = b.filter(done)
        if local.num_rows:
            place, shape, of_place = (local.column(c).to_numpy() for c in ("place", "shape", "of_place"))
            first, last = _span(shape)
            yield pa.RecordBatch.from_arrays([local.column("doc_id"), pa.array(place - first), pa.array(place - last + LENGTH), pa.nulls(local.num_rows, pa.int64()), pa.array(first.astype(np.int32)), local.column("of_doc"), pa.array(of_place - first)], names)
        rest = pa.Table.from_batches([b.filter(pa.compute.invert(done))])
        carry = rest if carry is None else pa.concat_tables([carry, rest])
        if carry.num_rows > 50_000:
            name, context = carry.column("anchor").to_numpy(), carry.column("context").to_numpy()
            cut = int(np.searchsorted(name, name[-1]))  # the last anchor may go on
            if cut:
                yield decide(carry.slice(0, cut))[0]
                carry, going = carry.slice(cut), None
            elif context[0] != context[-1] or going and going[0] == name[0]:
                out, going = decide(carry, whole=False)
                yield out
                carry = carry.slice(carry.num_rows)
            else:  # one context so far: its first row waits
                yield decide(carry)[0]
                carry = carry.slice(0, 1)
    if carry is not None and carry.num_rows:
        yield decide(carry)[0]


PIECES = "doc_id long, begin long, stop long, of_doc long, of_begin long"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts that follow one source without a gap, as one piece; rows are sorted by document, source, shift and begin."""
    for b in batches:
        doc, begin, stop, of_doc, of_begin = (b.column(c).to_numpy() for c in ("doc_id", "begin", "stop", "of_doc", "of_begin"))
        if not len(doc):
            continue
        shift, cell = begin - of_begin, of_begin // STRETCH
        new = np.append(True, (doc[1:] != doc[:-1]) | (of_doc[1:] != of_doc[:-1]) | (shift[1:] != shift[:-1]) | (cell[1:] != cell[:-1]) | (begin[1:] > stop[:-1]))
        last = np.append(new[1:], True)  # stops ascend with begins
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (doc[new], begin[new], stop[last], of_doc[new], of_begin[new])], [c.split()[0] for c in PIECES.split(", ")])


TEXTS = "key long, doc_id long, begin long, low int, high int, bytes binary"


def _parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The left and the right part of texts, of which bytes [low, high) lie in every string, under the names of their new
    common bytes: strings that hold the next `half` bytes to the left, and those that do not and so hold more to the right."""
    names = [c.split()[0] for c in TEXTS.split(", ")]
    for b in batches:
        out: list[tuple] = []
        for key, doc, begin, low, high, text in zip(*(b.column(c).to_pylist() for c in names), strict=True):
            rest = LENGTH - (high - low)
            half = (rest + 1) // 2
            more = rest - half + 1
            ends = len(text) - LENGTH  # the last string's start
            if half and low >= half:
                stop = min(ends, low - half)
                name = xxhash.xxh64_intdigest(text[low - half : low], seed=key & 0xFFFFFFFF) - (1 << 63)
                out.append((name, doc, begin, low - half, high, text[: stop + LENGTH]))
            first = max(0, low - half + 1)
            if first <= ends:
                name = xxhash.xxh64_intdigest(text[high : high + more], seed=(key ^ 0x5BD1E995) & 0xFFFFFFFF) - (1 << 63)
                out.append((name, doc, begin + first, low - first, high + more - first, text[first:]))
        columns = list(zip(*out, strict=True)) if out else [()] * 6
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def suffix_arrays(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Suffix arrays of many texts at once, by grouping. `text` holds symbols from 1 to 511, each text ends in a 0 that it has
    nowhere else, and begins at `starts`. Returns for each place of the layout the suffix (its index in `text`)."""
    total = len(text)
    sizes = np.diff(np.append(starts, total))
    base = np.repeat(starts, sizes)
    bits = U(total.bit_length())
    sa = (np.sort(((base.astype(np.uint64) << U(9) | text.astype(np.uint64)) << bits) | np.arange(total, dtype=np.uint64)) & ((U(1) << bits) - U(1))).astype(np.int64)
    isa = np.empty(total, np.int64)
    isa[sa] = np.arange(total)
    new = np.append(True, (text[sa][1:] != text[sa][:-1]) | (base[sa][1:] != base[sa][:-1]))
    begin = np.maximum.accumulate(np.where(new, np.arange(total), 0))
    group = np.empty(total, np.int64)  # of each suffix: where its group begins
    group[sa] = begin
    width = np.zeros(total, np.int64)  # at a group's begin
    width[begin[new]] = np.bincount(np.cumsum(new) - 1)
    before = np.arange(total) - 1  # the previous smaller suffix, once the group was taken
    before[starts] = -1

    def spread(at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at, n)

    leaves = np.zeros(total, bool)

    # first phase: each text's groups from the largest down
    edge = starts + sizes
    live = np.arange(len(starts))
    while len(live):
        g = group[sa[edge[live] - 1]]
        members = sa[spread(g, width[g])]
        level = np.repeat(g, width[g])
        j = before[members]
        climbing, at = np.arange(len(j)), j
        while True:
            on = np.flatnonzero((at >= 0) & (group[at] >= level[climbing]))
            if not len(on):
                break
            climbing, at = climbing[on], before[at[on]]
            j[climbing] = at
        before[members] = j
        edge[live] = g
        j = j[j >= 0]
        if len(j):
            moved, times = np.unique(j, return_counts=True)
            home = group[moved]
            order = np.lexsort((times, home))
            moved, times, home = moved[order], times[order], home[order]
            cut = np.append(True, home[1:] != home[:-1])
            h, n = home[cut], np.diff(np.append(np.flatnonzero(cut), len(home)))
            slot = spread(h + width[h] - n, n)  # the last places of each group, larger multiples last
            # whoever sits there without moving changes places with one that moves from further left
            own = isa[moved]
            leaving = own < np.repeat(h + width[h] - n, n)
            staying = sa[slot]
            leaves[moved] = True
            out = staying[~leaves[staying]]
            leaves[moved] = False
            sa[own[leaving]] = out
            isa[out] = own[leaving]
            sa[slot] = moved
            isa[moved] = slot
            fresh = cut | np.append(True, times[1:] != times[:-1])
            at = slot[fresh]
            count = np.diff(np.append(np.flatnonzero(fresh), len(moved)))
            width[h] -= n
            width[at] = count
            group[moved] = np.repeat(at, count)
        live = live[edge[live] > starts[live]]

    # second phase: from the smallest suffix up, each places those that end their Lyndon prefix before it
    result = np.full(total, -1)
    result[starts] = edge_last = starts + sizes - 1
    fill = np.arange(total)  # next free place of the group that begins here
    fill[group[edge_last]] += 1
    live = np.arange(len(starts))
    rank = 0
    while len(live):
        s = result[starts[live] + rank]
        stop, j = before[s], s - 1
        on = s > starts[live]
        stop, j = stop[on], j[on]
        while len(j):
            on = j != stop
            stop, j = stop[on], j[on]
            if not len(j):
                break
            g = group[j]
            result[fill[g]] = j
            fill[g] += 1
            j = before[j]
        rank += 1
        live = live[sizes[live] > rank]
    return result


def _sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats among the texts of each key; rows are sorted by key, bytes, document and begin. Of the rows of one text the
    first is sorted; the others repeat it whole. Keys with about as many bytes are sorted side by side: the largest one's
    size is the number of steps."""
    group: list[tuple] = []  # of the last key
    held: dict[int, list[tuple]] = {}  # by the size of a key, to a power of 4
    filled: dict[int, int] = {}
    again: list[tuple[int, int, int]] = []

    def copies() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*again, strict=True) if again else ((), (), ()))], ["doc_id", "begin", "stop"])

    def ready() -> Iterator[pa.RecordBatch]:
        """Put the last key to those of its size, and sort them if they are many."""
        size = sum(len(x[3]) for x in group)
        kind = size.bit_length() // 2
        held.setdefault(kind, []).extend(group)
        filled[kind] = filled.get(kind, 0) + size
        group.clear()
        if filled[kind] > TOGETHER:
            yield close(held.pop(kind))
            del filled[kind]

    def close(held: list[tuple]) -> pa.RecordBatch:
        lengths = np.array([len(x[3]) for x in held])
        place = np.cumsum(lengths + 1) - lengths - 1
        key = np.array([x[0] for x in held])
        new = np.append(True, key[1:] != key[:-1])
        symbols = np.frombuffer(b"\0".join([*(x[3] for x in held), b""]), np.uint8)
        text = symbols.astype(np.int64) + 2
        text[place + lengths] = np.where(np.append(new[1:], True), 0, 1)
        sizes = lengths - LENGTH + 1
        doc, begin = np.array([x[1] for x in held]), np.array([x[2] for x in held])
        sa = suffix_arrays(text, place[new])
        # of each suffix that starts a whole string: its context and place there
        row = np.full(len(text), -1)
        spot = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        owner = np.repeat(np.arange(len(held)), sizes)
        row[place[owner] + spot] = np.arange(len(owner))
        r = row[sa]
        r = r[r >= 0]
        suffix = (place[owner] + spot)[r]
        view = np.lib.stride_tricks.sliding_window_view(symbols, LENGTH)
        same = np.zeros(len(r), bool)
        for k in range(1, len(r), 1 << 14):
            e = min(len(r), k + (1 << 14))
            same[k:e] = (view[suffix[k:e]] == view[suffix[k - 1 : e - 1]]).all(1)
        # the same string under another anchor would be another text's suffix
        kind = np.cumsum(~same)
        d, s = doc[owner][r], begin[owner][r] + spot[r]
        order = np.lexsort((s, d, kind))
        repeat = np.append(False, kind[order][1:] == kind[order][:-1])
        d, s = d[order][repeat], s[order][repeat]
        return _joined(d, s)

    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("key", "doc_id", "begin", "bytes")), strict=True):
            if group and row[0] != group[-1][0]:
                yield from ready()
            if group and row[3] == group[-1][3]:
                again.append((row[1], row[2], row[2] + len(row[3])))
            else:
                group.append(row)
        yield copies()
        again.clear()
    if group:
        yield from ready()
    for rows in held.values():
        yield close(rows)


def _joined(doc: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Starts of repeated strings as runs: document, begin, stop."""
    order = np.lexsort((start, doc))
    d, s = doc[order], start[order]
    new = np.append(True, (d[1:] != d[:-1]) | (s[1:] > s[:-1] + 1)) if len(d) else np.zeros(0, bool)
    end = np.append(new[1:], True) if len(d) else new
    return pa.RecordBatch.from_arrays([pa.array(d[new], pa.int64()), pa.array(s[new], pa.int64()), pa.array(s[end] + LENGTH, pa.int64())], ["doc_id", "begin", "stop"])


WANTED = "struct<kind:int,begin:bigint,stop:bigint,one:bigint,two:bigint>"
TEXT, COPY, SOURCE = 0, 1, 2
TAKEN = "kind int, doc_id long, begin long, one long, two long, bytes binary"


def _take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted stretches of each document."""
    for b in slices(batches, "text", SLICE):
        sizes = pa.compute.list_value_length(b.column("w")).to_numpy(zero_copy_only=False)
        kind, begin, stop, one, two = b.column("w").flatten().flatten()
        row, texts = np.repeat(np.arange(b.num_rows), sizes), b.column("text").to_pylist()
        ids = b.column("doc_id").take(pa.array(row))
        for k in range(0, len(row), 1 << 14):
            held = [texts[i][x:y] for i, x, y in zip(row[k : k + (1 << 14)].tolist(), begin.slice(k, 1 << 14).to_pylist(), stop.slice(k, 1 << 14).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(c.slice(k, 1 << 14) for c in (kind, ids, begin, one, two)), pa.array(held, pa.binary())], ["kind", "doc_id", "begin", "one", "two", "bytes"])


def differing(taken: DataFrame) -> DataFrame:
    """No rows, or an error: copies (one, two: their source's document and begin) whose bytes are not their source's."""
    copies = taken.where(f"kind = {COPY}").select("doc_id", "begin", "one", "two", "bytes", F.length("bytes").alias("n"))
    sources = taken.where(f"kind = {SOURCE}").select(F.col("one").alias("s1"), F.col("two").alias("s2"), F.length("bytes").alias("sn"), F.col("bytes").alias("source"))
    met = copies.join(sources, (F.col("one") == F.col("s1")) & (F.col("two") == F.col("s2")) & (F.col("n") == F.col("sn")), "left")
    wrong = F.coalesce(F.col("bytes") != F.col("source"), F.lit(True))
    return met.where(F.when(wrong, F.raise_error(F.lit("two different strings have one 64-bit name: change the hash's base"))).otherwise(F.lit(False))).select("doc_id", "begin", (F.col("begin") + F.col("n")).alias("stop"))


def _firsts(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The earliest row of each different text of a key, and doc_id, begin, stop of the other rows, which repeat it whole."""
    first = parts.groupBy("key", "low", "high", "bytes").agg(F.min(F.struct("doc_id", "begin")).alias("p"))
    first = materialize(first.select("key", "p.doc_id", "p.begin", "low", "high", "bytes"), "firsts")
    # a string lies in one part, so document and begin name a part
    copies = parts.join(first.select("key", "doc_id", "begin"), ["key", "doc_id", "begin"], "left_anti")
    return first, copies.select("doc_id", "begin", (F.col("begin") + F.length("bytes")).alias("stop"))


def sorted_repeats(texts: DataFrame, many: int = MANY) -> DataFrame:
    """doc_id, begin, stop of repeats among texts that share a key. Keys with over `many` different texts are parted first;
    parts that became the same text go on as one, so a text has new parts only around the places where it differs."""
    found, level, whole = [], texts, True
    while True:
        if whole:
            sizes = level.groupBy("key", F.xxhash64("bytes").alias("h")).agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("d"))
            sizes = materialize(sizes.where(f"n > 1 and d > {many}"), "sizes")
        else:
            sizes = materialize(level.groupBy("key").agg(F.count("*").alias("d")).where("d > 1"), "sizes")
        large = sizes.where(f"d > {many}").select("key")
        fine = level.join(large, "key", "left_anti") if whole else level.join(sizes.where(f"d <= {many}").select("key"), "key", "left_semi")
        found.append(fine.repartition("key").sortWithinPartitions("key", "bytes", "doc_id", "begin").mapInArrow(_sort, "doc_id long, begin long, stop long"))
        if large.limit(1).count() == 0:
            break
        parts = materialize(level.join(large, "key", "left_semi").mapInArrow(_parted, TEXTS), "parted")
        level, copies = _firsts(parts)
        found.append(copies)
        whole = False
    out = found[0]
    for rows in found[1:]:
        out = out.unionByName(rows)
    return out


def repeated(rows: DataFrame) -> DataFrame:
    """doc_id, begin, stop: stretches to remove, from rows (doc_id, text as bytes) with different doc_ids."""
    found = rows.where(F.length("text") >= LENGTH).mapInArrow(_contexts, CONTEXTS)
    dealt = found.repartition(F.coalesce("anchor", "context")).sortWithinPartitions("anchor", "context", "doc_id", "place")
    settled = materialize(dealt.mapInArrow(_settle, SETTLED), "settled")
    claims = settled.where("anchor is null").repartition("doc_id").sortWithinPartitions("doc_id", "of_doc", F.col("begin") - F.col("of_begin"), "begin")
    pieces = materialize(claims.select("doc_id", "begin", "stop", "of_doc", "of_begin").mapInArrow(_pieces, PIECES), "pieces")
    want = lambda df, kind, begin, stop, one, two: df.select("doc_id", F.struct(F.lit(kind).alias("kind"), begin.alias("begin"), stop.alias("stop"), one.alias("one"), two.alias("two")).cast(WANTED).alias("w"))
    c = F.col
    sources = pieces.select(c("of_doc").alias("doc_id"), c("of_begin").alias("begin"), (c("of_begin") + c("stop") - c("begin")).alias("stop")).distinct()
    wanted = want(settled.where("anchor is not null"), TEXT, c("begin"), c("stop"), c("anchor"), c("at"))
    wanted = wanted.union(want(pieces, COPY, c("begin"), c("stop"), c("of_doc"), c("of_begin"))).union(want(sources, SOURCE, c("begin"), c("stop"), c("doc_id"), c("begin")))
    wanted = wanted.groupBy("doc_id").agg(F.collect_list("w").alias("w"))  # of one document
    taken = materialize(rows.join(wanted, "doc_id").select("doc_id", "text", "w").mapInArrow(_take, TAKEN), "taken")
    texts = taken.where(f"kind = {TEXT}").select(c("one").alias("key"), "doc_id", "begin", c("two").cast("int").alias("low"), (c("two") + GRAM).cast("int").alias("high"), "bytes")
    return pieces.select("doc_id", "begin", "stop").unionByName(differing(taken)).unionByName(sorted_repeats(texts))


def _cut(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text", SLICE):
        kept, removed, spans = [], [], []
        for t, gaps in zip(b.column("text").to_pylist(), b.column("gaps").to_pylist(), strict=True):
            out, at, runs = [], 0, 0
            for begin, stop in sorted((g["begin"], g["stop"]) for g in gaps or []):
                if begin > at or not runs:
                    out.append(t[at:begin])
                    runs += 1
                at = max(at, stop)
            out.append(t[at:])
            kept.append(b"".join(out))
            removed.append(len(t) - len(kept[-1]))
            spans.append(runs)
        last = pa.array([hashlib.sha256(k).hexdigest() for k in kept]) if digest else pa.array(kept, pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.compute.cast(pa.compute.binary_length(b.column("text")), pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), last], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept"])


def remove_repeats(docs: DataFrame, digest: bool = True) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, and the digest of the remaining bytes, or the bytes themselves."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    odd = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").limit(1).count()
    ids = None
    if odd:  # rows without a doc_id of their own are told apart by their place in the order
        dealt = numbered(rows.distinct(), "n", F.asc_nulls_first("doc_id"), F.col("text"))
        ids, rows = dealt.select(F.col("n").alias("doc_id"), F.col("doc_id").alias("given"), F.sha2("text", 256).alias("own")), dealt.select(F.col("n").alias("doc_id"), "text")
    gaps = repeated(rows).groupBy("doc_id").agg(F.collect_list(F.struct("begin", "stop")).alias("gaps"))  # of one document
    last = "kept_sha256 string" if digest else "kept binary"
    out = rows.join(gaps, "doc_id", "left").select("doc_id", "text", "gaps").mapInArrow(lambda b: _cut(b, digest), f"doc_id long, n_bytes long, n_removed long, n_spans long, {last}")
    if ids is None:
        return out
    named = ids.join(out, "doc_id").drop("doc_id")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256).alias("own"))
    twin = named.withColumnRenamed("own", "o")
    return given.join(twin, given["doc_id"].eqNullSafe(twin["given"]) & (given["own"] == twin["o"])).select("doc_id", "n_bytes", "n_removed", "n_spans", twin.columns[-2])
