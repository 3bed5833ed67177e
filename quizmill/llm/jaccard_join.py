"""Exact n-gram Jaccard self-join by universe partition and pigeonhole.

Shingles are hashed to 64 bits; a document is the set of its shingles, and equal sets are one node, named by a 64-bit hash of
the set. For two linked sets the symmetric difference is at most H = floor(u * (100 - threshold) / threshold), where u bounds
the smaller set. Sizes are cut into bands with one u each. In a band the universe of shingles is hashed into segments. With
b + 2r segments compared for equality and a segments compared through their one-deletion neighbourhoods, 2a + b > H, two
linked sets agree in a segment (equal, or equal but for one shingle), even if each of them leaves out r of its equality
segments. A set emits the keys of its own band and of each lower band that holds sets it can link with.

Allocation by cost: a and b are chosen per band from the number of emitted keys and the expected chance matches, which follow
from measured document frequencies of shingles; r segments are spare, and every set leaves out its r costliest ones (the fewer
shingles a segment holds, the more sets share it).

Sets with a common key are candidates. Keys held by the same sets count once. A key names a centre, at first its smallest
node, then the set with the most links, so that a group of n linked sets gives n - 1 pairs and not n * n. Keys whose sets then
still lie in different components are compared set by set in tiles of bounded size, by parity sketches, which bound the
symmetric difference from below. A tile returns no pairs: it returns the sets that have a near one in another component, and
a spanning forest of components that are near. Each tree of that forest is a cluster; its sets meet once, again in tiles of
bounded size, where the exact intersections are taken and each merge of two components is one row. So what leaves a task
grows with the number of sets, however large a group of copies is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizmill.llm.common import BROADCAST_BYTES, materialise, small, table

#: Shingles whose hash is a multiple of this serve the statistics that costs follow from, over all documents.
STATISTICS = 64
#: Costs, that of one key that is written, dealt and grouped being 1: of a key that other sets share, which is joined, written
#: and met by sketches again, and of one comparison of sketches.
SHARED_KEY, COMPARISON = 10.0, 0.1
#: Rows that one task groups; the number of partitions follows from it.
TASK_KEYS = 500_000
#: Texts are worked on in chunks of about this many bytes, so memory does not grow with a partition.
CHUNK_BYTES = 1 << 20
#: Rounds in which a key names a centre. More of them move many pairs for few links, which the tiles find as well.
HUB_ROUNDS = 1
#: Sets, and shingles in them, about, that one tile compares with as many others.
TILE, TILE_TOKENS = 4000, 8_000_000
#: Bytes of tiles that a task works on at once, or one tile.
TILE_BYTES = 32 << 20
#: 64-bit words of a parity sketch. Sets above FINE_FROM shingles have one 8 times as large, above 8 * FINE_FROM 64 times, ...
SKETCH, FINE_FROM = 16, 1200
#: Keys that a task holds before it combines those that its documents share.
CHUNK_KEYS = 600_000

U = np.uint64
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of the public SplitMix64 generator."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, 0x9E3779B97F4A7C15, U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct k-word shingles of each text, sorted, one after another, and the texts' bounds in them.

    Words are what blanks (space, \\t to \\r) separate, A-Z lower-cased. A text of fewer than k words, but not none, has one
    shingle, its whole sequence of words; null and wordless texts have none.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first, last = int(at[0]), int(at[-1])
    at = at - first
    if last == first:
        return np.empty(0, U), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[first:last]
    inside = ~_BLANK[data]
    before = np.concatenate(([False], inside[:-1]))
    before[at[:-1][at[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    if not len(starts):
        return np.empty(0, U), np.zeros(len(texts) + 1, np.int64)
    letters = _FOLD[data[inside]]
    begin = np.cumsum(inside)[starts] - 1  # of each word among the letters
    lengths = np.diff(np.append(begin, len(letters)))
    place = np.arange(len(letters)) - np.repeat(begin, lengths)
    words = mix(np.add.reduceat((letters.astype(U) + U(1)) * _powers(int(lengths.max()))[place], begin) + lengths.astype(U))
    bounds = np.searchsorted(starts, at)
    count = np.diff(bounds)
    turn = [U(c) for c in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165)]
    full = np.full(max(len(words) - k + 1, 0), k, U)
    for i in range(k):
        full += words[i : i + len(full)] * turn[i % 8] * U(1 + i // 8 * 2)
    full = mix(full)
    sizes = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    out, ends = np.empty(int(sizes.sum()), U), np.concatenate(([0], np.cumsum(sizes)))
    for i in np.flatnonzero(count):
        a, b, c, d = bounds[i], bounds[i + 1], ends[i], ends[i + 1]
        if count[i] >= k:
            out[c:d] = full[a : b - k + 1]
            out[c:d].sort()
        else:
            out[c] = mix(np.array([sum(int(words[a + j]) * int(turn[j % 8]) for j in range(b - a)) + int(b - a) & 0xFFFFFFFFFFFFFFFF], U))[0]
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[ends[:-1][sizes > 0]] = True
    kept = np.concatenate(([0], np.cumsum(new)))
    return out[new], kept[ends]


def fingerprints(tokens: np.ndarray, bounds: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each set."""
    f, g = np.zeros(len(bounds) - 1, U), np.zeros(len(bounds) - 1, U)
    held = np.diff(bounds) > 0
    if held.any():
        f[held] = np.add.reduceat(mix(tokens ^ U(0x5851F42D4C957F2D + seed)), bounds[:-1][held])
        g[held] = np.bitwise_xor.reduceat(mix(tokens ^ U(0x14057B7EF767814F)), bounds[:-1][held])
    return f, g


def chunks(batches, size: int = CHUNK_BYTES):
    """Arrow batches (doc_id, text) in pieces of about ``size`` bytes; a longer text is a piece of its own."""
    for batch in batches:
        sizes = np.cumsum(np.asarray(pc.binary_length(batch.column(1)).fill_null(0), np.int64))
        start = 0
        while start < batch.num_rows:
            done = sizes[start - 1] if start else 0
            stop = max(int(np.searchsorted(sizes, done + size, "right")), start + 1)
            yield batch.column(0).slice(start, stop - start), batch.column(1).slice(start, stop - start)
            start = stop


class Bands:
    """Bands of set sizes and the allocation of segments in each.

    ``shares`` are rows of (part of all sets, share of their shingles that other sets hold, how many others hold those on
    average). They decide the allocation, and with it speed, never the result.
    """

    def __init__(self, threshold: int, shares=((1.0, 0.2, 100.0),), ratio: float = 1.63):
        self.threshold, self.shares, self.ratio = threshold, shares, ratio
        first = -(-threshold // (100 - threshold)) if threshold < 100 else 1 << 40  # below, only equal sets link
        self.lows = [first]
        while self.lows[-1] <= 1 << 40:
            self.lows.append(max(self.lows[-1] + 1, int(self.lows[-1] * ratio)))
        self.plans: dict[int, tuple[int, int, int]] = {}

    def of(self, n: np.ndarray) -> np.ndarray:
        """The band of each size; -1 for sizes that link with equal sets only."""
        return np.searchsorted(self.lows, n, "right") - 1

    def plan(self, band: int) -> tuple[int, int, int]:
        """(a, b, r) of the band: deletion segments, equality segments, spare segments that each set may leave out.

        Every a from one to deletion segments alone is weighed: the keys that a set emits, those of them that other sets
        share, and the sets met in them.
        """
        if band not in self.plans:
            upper = self.lows[band + 1] - 1
            need = upper * (100 - self.threshold) // self.threshold + 1
            a = np.arange(1, need // 2 + need % 2 + 1)
            b = np.maximum(need - 2 * a, 0)
            r = b // 16
            per = upper / self.ratio**0.5 / (a + b + 2 * r)
            cost = b + r + a * (per + 1)
            for part, share, others in self.shares:
                for keys, left in ((b, per), (a * (per + 1), np.maximum(per - 1, 0))):
                    met = others * share**left
                    cost = cost + part * keys * (SHARED_KEY * np.minimum(met, 1) + COMPARISON * met)
            best = int(cost.argmin())
            self.plans[band] = int(a[best]), int(b[best]), int(r[best])
        return self.plans[band]


def signatures(tokens: np.ndarray, bounds: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(key, index of the set) for each emitted key."""
    n = np.diff(bounds)
    own = bands.of(n)
    lowest = np.maximum(bands.of(-(-n * bands.threshold // 100)), 0)  # the smallest size that a set of n links with
    keys, sets = [], []
    for band in range(int(own.max()) + 1) if len(own) else ():
        here = np.flatnonzero((own >= band) & (lowest <= band))
        if not len(here):
            continue
        a, b, r = bands.plan(band)
        m = a + b + 2 * r
        for part in np.array_split(here, max(1, len(here) * m // 1_000_000)):
            size = n[part]
            took = np.repeat(bounds[part] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
            t = tokens[took]
            cell = np.repeat(np.arange(len(part)), size) * m + (mix(t ^ U(0xD1B54A32D192ED03 + band)) % U(m)).astype(np.int64)
            value = mix(t ^ U(0x8CB92BA72F3D8DD7))
            total = np.zeros(len(part) * m, U)
            np.add.at(total, cell, value)
            held = np.bincount(cell, minlength=len(part) * m)
            salt = mix((U(band) << U(32)) + np.arange(m, dtype=U) + U(1))
            emit = np.ones((len(part), m), bool)
            if r:
                left = np.argpartition(held.reshape(len(part), m)[:, a:], r - 1, axis=1)[:, :r] + a
                np.put_along_axis(emit, left, False, axis=1)
            flat = np.flatnonzero(emit)
            keys.append(mix(total[flat] + salt[flat % m]))
            sets.append(part[flat // m])
            if a:
                d = np.flatnonzero(cell % m < a)
                keys.append(mix(total[cell[d]] - value[d] + salt[cell[d] % m]))
                sets.append(part[cell[d] // m])
    return (np.concatenate(keys), np.concatenate(sets)) if keys else (np.empty(0, U), np.empty(0, np.int64))


_WORDS = [f"b{i}" for i in range(SKETCH)]
SET_SCHEMA = "doc_id long, n long, f long, g long, fine array<long>, " + ", ".join(f"{w} long" for w in _WORDS)
#: ``key`` as its difference from ``p``, which is zero for most rows and takes no room when packed.
KEY_SCHEMA = "p long, key long, f long, n int, kind int"


def level(n: int) -> int:
    """Words of the sketch of a set of n shingles: SKETCH times the power of 8 that leaves at most 1.2 shingles a bit."""
    words, most = SKETCH, FINE_FROM
    while n > most:
        words, most = words * 8, most * 8
    return words


def sketches(tokens: np.ndarray, bounds: np.ndarray, words: int) -> np.ndarray:
    """Parity of the tokens in each of words * 64 cells. Two sets differ in at least as many tokens as sketches in bits.

    A larger sketch, cut into parts of a smaller one's size, gives the smaller one as the parity of its parts.
    """
    bits = words * 64
    cell = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) * bits + (mix(tokens ^ U(0x632BE59BD9B4E019)) % U(bits)).astype(np.int64)
    odd = (np.bincount(cell, minlength=(len(bounds) - 1) * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(-1, bits), axis=1).view(np.int64)


def fold(sketch: np.ndarray, words: int) -> np.ndarray:
    return np.bitwise_xor.reduce(sketch.reshape(-1, words), axis=0)


def set_rows(batches, k: int, seed: int = 0):
    """Size, fingerprint and sketches of each text."""
    for ids, texts in chunks(batches):
        for at in range(0, len(ids), 2000):
            part = ids.slice(at, 2000)
            tokens, bounds = shingle_sets(texts.slice(at, 2000), k)
            f, g = fingerprints(tokens, bounds, seed)
            fine = [sketches(tokens[a:b], np.array([0, b - a]), level(b - a))[0] if b - a > FINE_FROM else None for a, b in zip(bounds[:-1], bounds[1:])]
            coarse = np.ascontiguousarray(sketches(tokens, bounds, SKETCH).T)
            columns = [part.cast(pa.int64()), pa.array(np.diff(bounds)), pa.array(f.view(np.int64)), pa.array(g.view(np.int64)), pa.array(fine, pa.list_(pa.int64())), *map(pa.array, coarse)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "f", "g", "fine", *_WORDS])


def frequency_rows(batches, k: int, seed: int = 0):
    """The chosen shingles of each set, for the statistics."""
    for _, texts in chunks(batches):
        nodes, tokens, bounds = _distinct_sets(*shingle_sets(texts, k), seed)
        chosen = mix(tokens) % U(STATISTICS) == 0
        yield pa.RecordBatch.from_arrays([pa.array(tokens[chosen].view(np.int64)), pa.array(np.repeat(nodes, np.diff(bounds))[chosen].view(np.int64))], names=["t", "f"])


def _combined(keys: np.ndarray, sets: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    """Of each key one row with the smallest node of this chunk, to be shuffled by the key (kind 0; 1 if others share it here);
    the others are spread by their own hash (kind 2)."""
    order = np.lexsort((sets, keys))
    keys, sets, sizes = keys[order], sets[order], sizes[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    again = ~new
    again[1:] &= sets[1:] != sets[:-1]
    head = np.flatnonzero(new)
    several = np.zeros(len(keys), bool)
    several[head] = np.add.reduceat(again, head) > 0
    keep = new | again
    kind = np.where(new, several.astype(np.int32), np.int32(2))[keep].astype(np.int32)
    keys, sets, sizes = keys[keep], sets[keep], sizes[keep]
    p = np.where(kind == 2, mix(keys ^ sets), keys)
    columns = [pa.array(p.view(np.int64)), pa.array((keys ^ p).view(np.int64)), pa.array(sets.view(np.int64)), pa.array(sizes.astype(np.int32)), pa.array(kind)]
    return pa.RecordBatch.from_arrays(columns, names=["p", "key", "f", "n", "kind"])


def key_rows(batches, k: int, bands: Bands, seed: int = 0):
    held: list[tuple] = []
    for _, texts in chunks(batches):
        tokens, bounds = shingle_sets(texts, k)
        nodes, tokens, bounds = _distinct_sets(tokens, bounds, seed)
        key, at = signatures(tokens, bounds, bands)
        held.append((key, nodes[at], np.diff(bounds)[at]))
        if sum(len(x[0]) for x in held) >= CHUNK_KEYS:
            yield _combined(*map(np.concatenate, zip(*held)))
            held = []
    if held:
        yield _combined(*map(np.concatenate, zip(*held)))


def _distinct_sets(tokens, bounds, seed):
    """The nodes of this chunk, each set once, without empty ones."""
    f, _ = fingerprints(tokens, bounds, seed)
    n = np.diff(bounds)
    held = np.flatnonzero(n)
    keep = np.sort(held[np.unique(f[held], return_index=True)[1]])
    if len(keep) == len(f):
        return f, tokens, bounds
    took = np.zeros(len(f), bool)
    took[keep] = True
    return f[keep], tokens[np.repeat(took, n)], np.concatenate(([0], np.cumsum(n[keep])))


def _columns(batches) -> list[np.ndarray] | None:
    parts = [b for b in batches if b.num_rows]
    return [c.combine_chunks() for c in pa.Table.from_batches(parts).columns] if parts else None


def member_rows(batches):
    """Of the rows dealt by key: those whose key several sets share."""
    data = _columns(batches)
    if data is None:
        return
    p, key, f, n, kind = map(np.asarray, data)
    key = key ^ p
    near = kind == 2
    out = [(key[near], f[near], n[near])]
    key, f, n, kind = key[~near], f[~near], n[~near], kind[~near]
    order = np.lexsort((f, key))
    key, f, n, kind = key[order], f[order], n[order], kind[order]
    if len(key):
        head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(head, len(key)))
        other = np.concatenate(([True], (key[1:] != key[:-1]) | (f[1:] != f[:-1])))  # a set comes once for each chunk
        shared = np.repeat((np.add.reduceat(other.astype(int), head) > 1) | (np.maximum.reduceat(kind, head) > 0), sizes) & other
        out.append((key[shared], f[shared], n[shared]))
    for columns in out:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "f", "n"])


def token_rows(batches, k: int, seed: int = 0):
    for _, texts in chunks(batches):
        tokens, bounds = shingle_sets(texts, k)
        f, _ = fingerprints(tokens, bounds, seed)
        lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(tokens.view(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), lists], names=["f", "tokens"])


def whole_tiles(batches, size: int = TILE_BYTES):
    """Rows sorted by their first column, the tile, in columns of whole tiles: about ``size`` bytes at a time, or one tile."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.nbytes for b in held) < size:
            continue
        last = batch.column(0)[-1].as_py()  # this tile may go on
        i, at = next((i, at[0]) for i, b in enumerate(held) if len(at := np.flatnonzero(np.asarray(b.column(0)) == last)))
        if i or at:
            yield _columns([*held[:i], held[i].slice(0, at)])
            held = [held[i].slice(at), *held[i + 1 :]]
    if held:
        yield _columns(held)


def _groups(tile: np.ndarray, *by: np.ndarray):
    """Row numbers of each tile, ordered by ``by`` within it, the last key first as for lexsort."""
    order = np.lexsort((*by, tile))
    head = np.flatnonzero(np.concatenate(([True], tile[order][1:] != tile[order][:-1])))
    return np.split(order, head[1:])


class Forest:
    """Labels of rows that are joined step by step; ``join`` returns one pair for each merge."""

    def __init__(self, parts: np.ndarray):
        _, first, at = np.unique(parts, return_index=True, return_inverse=True)
        self.label = first[at]

    def join(self, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        us, vs = [], []
        while True:
            a, b = self.label[u], self.label[v]
            apart = a != b
            if not apart.any():
                break
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            high, first = np.unique(np.maximum(a, b), return_index=True)
            us.append(u[first])
            vs.append(v[first])
            up = np.arange(len(self.label))
            up[high] = np.minimum(a, b)[first]
            while (up[up] != up).any():
                up = up[up]
            self.label = up[self.label]
        none = np.empty(0, np.int64)
        return (np.concatenate(us), np.concatenate(vs)) if us else (none, none)


def _coarse_near(words, n, u, v, threshold):
    apart = np.bitwise_count(words[u] ^ words[v]).sum(1, dtype=np.int64)
    return apart * (100 + threshold) <= (100 - threshold) * (n[u] + n[v])


class SketchTile:
    """Which pairs of one tile's sets may link, by sketches: coarse ones of all sets, larger ones where both sets have them.
    Larger sketches are folded to each size that a comparison needs, on first need."""

    def __init__(self, columns: list, rows: np.ndarray, n: np.ndarray, threshold: int):
        ends, values = np.asarray(columns[0].offsets), np.asarray(columns[0].values).view(U)
        self.held = {i: values[ends[r] : ends[r + 1]] for i, r in enumerate(rows.tolist()) if ends[r + 1] > ends[r]}
        self.coarse = np.stack([np.asarray(x)[rows] for x in columns[1:]], axis=1).view(U)
        self.n, self.threshold, self.folded = n, threshold, {}
        self.words = np.array([level(x) for x in n]) if self.held else None

    def at(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        if words not in self.folded:
            rows = np.flatnonzero(self.words >= words)
            place = np.zeros(len(self.n), np.int64)
            place[rows] = np.arange(len(rows))
            self.folded[words] = np.stack([fold(self.held[i], words) for i in rows.tolist()]), place
        return self.folded[words]

    def near(self, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that stay near."""
        near = _coarse_near(self.coarse, self.n, u, v, self.threshold)
        u, v = u[near], v[near]
        if not self.held or not len(u):
            return u, v
        out = np.ones(len(u), bool)
        both = np.minimum(self.words[u], self.words[v])
        for words in np.unique(both[both > SKETCH]).tolist():
            at = np.flatnonzero(both == words)
            sketch, place = self.at(words)
            for part in np.array_split(at, len(at) * words // 4_000_000 + 1):
                apart = np.bitwise_count(sketch[place[u[part]]] ^ sketch[place[v[part]]]).sum(1, dtype=np.int64)
                out[part] = apart * (100 + self.threshold) <= (100 - self.threshold) * (self.n[u[part]] + self.n[v[part]])
        return u[out], v[out]


def near_rows(batches, threshold: int, compare=SketchTile):
    """Rows (tile, block, f, n, c, what ``compare`` needs), sorted by tile -> ``kind, x, y``: sets x that have a near set in
    another component y (kind 0: y is their own), and pairs of near components, a spanning forest for each tile (kind 1)."""
    for data in whole_tiles(batches):
        tile, block, f, n, c = map(np.asarray, data[:5])
        # the largest component comes last: its sets need no comparison with one another
        _, at, count = np.unique(mix(tile.view(U) + mix(c.view(U))), return_inverse=True, return_counts=True)
        kinds, xs, ys = [], [], []
        for rows in _groups(tile, f, c, count[at]):
            forest, touched = Forest(c[rows]), np.zeros(len(rows), bool)
            size, part, cell = n[rows], c[rows], block[rows]
            single = (cell == cell[0]).all()
            sets = compare(data[5:], rows, size, threshold)
            step = max(1, 500_000 // len(rows) // SKETCH)
            for i in range(0, len(rows), step):
                if part[i] == part[-1]:
                    break
                left, right = np.arange(i, min(i + step, len(rows)))[:, None], np.arange(i, len(rows))[None, :]
                fits = (part[left] != part[right]) & (left < right) & (100 * np.minimum(size[left], size[right]) >= threshold * np.maximum(size[left], size[right]))
                if not single:
                    fits &= cell[left] != cell[right]
                # sets that are known to have a near one need not meet again if their components are joined in this tile
                fits &= ~(touched[left] & touched[right] & (forest.label[left] == forest.label[right]))
                u, v = np.nonzero(fits)
                u, v = sets.near(u + i, v + i)
                touched[u] = touched[v] = True
                a, b = forest.join(u, v)
                kinds.append(np.ones(len(a), np.int32))
                xs.append(part[a])
                ys.append(part[b])
            kinds.append(np.zeros(int(touched.sum()), np.int32))
            xs.append(f[rows][touched])
            ys.append(part[touched])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (kinds, xs, ys)], names=["kind", "x", "y"])


def merge_rows(batches, threshold: int):
    """Rows (tile, block, f, c, tokens), sorted by tile -> ``x, y``: linked sets of different components, one pair for each merge in a tile.

    A set is marked among the shingles of its tile and met with all near sets of other components at once; the sizes of the
    intersections are exact.
    """
    for data in whole_tiles(batches):
        tile, block, f, c = map(np.asarray, data[:4])
        lists = data[4]
        ends, values = np.asarray(lists.offsets, np.int64), np.asarray(lists.values).view(U)
        xs, ys = [], []
        for rows in _groups(tile, f, c):
            forest, part, cell = Forest(c[rows]), c[rows], block[rows]
            single = (cell == cell[0]).all()
            tokens = [values[ends[r] : ends[r + 1]] for r in rows]
            n = np.array(list(map(len, tokens)))
            bounds = np.concatenate(([0], np.cumsum(n)))
            _, token = np.unique(np.concatenate(tokens), return_inverse=True)
            sketch = np.concatenate([sketches(np.concatenate(tokens[i : i + 1000]), bounds[i : i + 1001] - bounds[i], SKETCH) for i in range(0, len(rows), 1000)]).view(U)
            mark = np.zeros(int(token.max()) + 1, bool)
            for u in range(len(rows)):
                v = np.arange(u + 1, len(rows))
                v = v[(forest.label[v] != forest.label[u]) & (100 * np.minimum(n[v], n[u]) >= threshold * np.maximum(n[v], n[u]))]
                if not single:
                    v = v[cell[v] != cell[u]]
                v = v[_coarse_near(sketch, n, np.full(len(v), u), v, threshold)]
                if not len(v):
                    continue
                mark[token[bounds[u] : bounds[u + 1]]] = True
                if len(v) * 4 > len(rows) - u:
                    both = np.add.reduceat(mark[token[bounds[u] :]], bounds[u:-1] - bounds[u], dtype=np.int64)[v - u]
                else:
                    both = np.array([int(mark[token[bounds[i] : bounds[i + 1]]].sum()) for i in v])
                mark[token[bounds[u] : bounds[u + 1]]] = False
                linked = v[100 * both >= threshold * (n[u] + n[v] - both)]
                a, b = forest.join(np.full(len(linked), u), linked)
                xs.append(f[rows][a])
                ys.append(f[rows][b])
        none = [np.empty(0, np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(xs or none)), pa.array(np.concatenate(ys or none))], names=["x", "y"])


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) of the nodes of ``edges(x, y)``.

    Each round a node takes the smallest label of itself and its neighbours, then the label of its label, until nothing
    changes; labels are written to the shared folder between rounds.
    """
    both = materialise(edges.select("x", "y").union(edges.select("y", "x")).distinct(), "edges")
    labels = materialise(both.groupBy("x").agg(F.least("x", F.min("y")).alias("component")).withColumnRenamed("x", "node"), "labels")
    while True:
        near = both.join(labels, both["y"] == labels["node"]).groupBy("x").agg(F.min("component").alias("near"))
        step = labels.join(near, labels["node"] == near["x"]).select("node", F.col("component").alias("old"), F.least("component", "near").alias("c"))
        jump = labels.select(F.col("node").alias("c"), F.col("component").alias("far"))
        new = materialise(step.join(jump, "c").select("node", "old", F.least("c", "far").alias("component")), "labels")
        labels = new.select("node", "component")
        if new.filter("component <> old").isEmpty():
            return labels


def all_of(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


class Join:
    """The steps of one join: ``rows(doc_id, n, f, g, ...)`` of all documents, and what they are compared by."""

    #: What ``rows`` has besides, and what compares the sets of a tile by it.
    columns, schema, compare = ["fine", *_WORDS], SET_SCHEMA, SketchTile

    def describe(self, seed: int):
        k = self.k
        return lambda batches: set_rows(batches, k, seed)

    def __init__(self, docs: DataFrame, k: int, threshold: int):
        self.docs, self.k, self.threshold = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), k, threshold
        self.seed = 0
        while True:  # a node is named by 64 bits of its set's hash; another 64 bits and the size show if two sets share a name
            seed = self.seed
            self.rows = materialise(self.docs.mapInArrow(self.describe(seed), self.schema), "sketches")
            named = self.rows.filter("n > 0").groupBy("n", "f", "g").agg(F.min("doc_id").alias("doc_id"))
            self.nodes = materialise(named, "nodes")
            if self.nodes.groupBy("f").count().filter("count > 1").isEmpty():
                break
            self.seed += 1

    def sketched(self, nodes: DataFrame) -> DataFrame:
        """One row of sketches for each of ``nodes(f)``."""
        return self.rows.drop("doc_id", "g").join(small(nodes), "f", "left_semi").dropDuplicates(["f"])

    def tokens(self, nodes: DataFrame) -> DataFrame:
        """``f, tokens`` of each of ``nodes(f)``; only the texts of their smallest ids are read again."""
        k, seed = self.k, self.seed
        ids = self.nodes.join(small(nodes), "f", "left_semi").select("doc_id").distinct()
        texts = self.docs.join(small(materialise(ids, "involved")), "doc_id", "left_semi")
        found = texts.mapInArrow(lambda it: token_rows(it, k, seed), "f long, tokens array<long>")
        return found.join(small(nodes), "f", "left_semi").dropDuplicates(["f"])

    def bands(self) -> Bands:
        """Bands with the allocation that the documents' own statistics suggest."""
        k, seed = self.k, self.seed
        found = self.docs.filter("doc_id is not null").mapInArrow(lambda it: frequency_rows(it, k, seed), "t long, f long")
        found = found.distinct()
        shared = found.join(found.groupBy("t").agg((F.count("*") - 1).alias("others")), "t")
        held = F.col("others") > 0
        of = shared.groupBy("f").agg(F.avg(held.cast("double")).alias("share"), F.coalesce(F.avg(F.when(held, F.col("others"))), F.lit(0.0)).alias("others"))
        bins = of.groupBy(F.round(F.col("share") * 20).alias("bin")).agg(F.count("*").alias("sets"), F.avg("others").alias("others")).collect()  # 21 rows at most
        total = sum(r.sets for r in bins)
        return Bands(self.threshold, [(r.sets / total, r.bin / 20, r.others) for r in bins])

    def groups(self) -> DataFrame:
        """``key, f, n``: keys that several sets hold; of keys held by the same sets, one."""
        k, seed, bands = self.k, self.seed, self.bands()
        total = self.nodes.agg(F.sum("n")).first()[0] or 0
        expected = total * (100 - self.threshold) / max(self.threshold, 1) * 1.7
        dealt = self.docs.filter("doc_id is not null").mapInArrow(lambda it: key_rows(it, k, bands, seed), KEY_SCHEMA).repartition(int(expected // TASK_KEYS) + 1, "p")
        return self.lists(materialise(dealt.mapInArrow(member_rows, "key long, f long, n int").distinct(), "members"))

    def lists(self, held: DataFrame) -> DataFrame:
        """Of ``held(key, f, n)`` the keys that several sets hold; of keys held by the same sets, one."""
        same = held.groupBy("key").agg(F.count("*").alias("size"), F.sum(F.xxhash64("f").cast("decimal(20,0)")).alias("s"), F.bit_xor(F.xxhash64("f", F.lit(7))).alias("t"))
        same = same.filter("size > 1").groupBy("size", "s", "t").agg(F.min("key").alias("key"))
        return materialise(held.join(same, "key", "left_semi"), "groups")

    def mixed(self, placed: DataFrame, parts: DataFrame | None) -> DataFrame:
        """``key, f, n, c, size, total``: the keys whose sets lie in several components c."""
        placed = placed.select("key", "f", "n")
        if parts is None:
            placed = placed.withColumn("c", F.col("f"))
        else:
            placed = placed.join(small(parts), F.col("f") == parts["node"], "left").select("key", "f", "n", F.coalesce("component", "f").alias("c"))
        several = placed.groupBy("key").agg(F.min("c").alias("a"), F.max("c").alias("b"), F.count("*").alias("size"), F.sum("n").alias("total"))
        return materialise(placed.join(several.filter("a <> b").select("key", "size", "total"), "key"), "mixed")

    def hub_links(self, placed: DataFrame, links: list[DataFrame]) -> DataFrame:
        """Links between the centre of each key and its other sets, by the exact intersection.

        Of pairs that link, the symmetric difference d satisfies d * (100 + threshold) <= (100 - threshold) * (|x| + |y|); the
        sketches bound d from below and refuse most pairs before any text is read again or any set moved.
        """
        ranked = placed.withColumn("degree", F.lit(0))
        if links:
            degree = all_of(links).select(F.explode(F.array("x", "y")).alias("f")).groupBy("f").agg(F.count("*").alias("degree"))
            ranked = placed.join(small(degree), "f", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
        best = F.max(F.struct("degree", (-F.col("f")).alias("o"), "f", "n", "c")).alias("h")
        hub = ranked.groupBy("key").agg(best).select("key", F.col("h.f").alias("x"), F.col("h.n").alias("nx"), F.col("h.c").alias("cx"))
        fits = (F.col("cx") != F.col("cy")) & (100 * F.least("nx", "ny") >= self.threshold * F.greatest("nx", "ny"))
        raw = hub.join(placed.select("key", F.col("f").alias("y"), F.col("n").alias("ny"), F.col("c").alias("cy")), "key").filter(fits)
        pairs = materialise(raw.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "pairs")

        near = materialise(self.near_pairs(pairs), "near")
        involved = materialise(near.select(F.explode(F.array("x", "y")).alias("f")).distinct(), "nodes")
        sets = materialise(self.tokens(involved), "sets")
        left, right = sets.select(F.col("f").alias("x"), F.col("tokens").alias("s")), sets.select(F.col("f").alias("y"), F.col("tokens").alias("t"))
        both = F.size(F.array_intersect("s", "t"))
        met = near.join(left, "x").join(right, "y").select("x", "y", both.alias("i"), (F.size("s") + F.size("t") - both).alias("u"))
        return materialise(met.filter(F.col("i") * 100 >= F.col("u") * self.threshold).select("x", "y"), "links")

    def near_pairs(self, pairs: DataFrame) -> DataFrame:
        """The ``pairs(x, y)`` that sketches do not refuse."""
        involved = materialise(pairs.select(F.explode(F.array("x", "y")).alias("f")).distinct(), "nodes")
        sketch = materialise(self.sketched(involved), "sketched")
        narrow = small(sketch.drop("fine"), 8 * (SKETCH + 2))
        left = narrow.select(F.col("f").alias("x"), F.col("n").alias("nx"), *_WORDS)
        right = narrow.select(F.col("f").alias("y"), F.col("n").alias("ny"), *(F.col(w).alias(f"c{w}") for w in _WORDS))
        apart = sum(F.bit_count(F.col(w).bitwiseXOR(F.col(f"c{w}"))) for w in _WORDS)
        most = (100 - self.threshold) * (F.col("nx") + F.col("ny"))
        near = pairs.join(left, "x").join(right, "y").filter(apart * (100 + self.threshold) <= most).select("x", "y", "nx", "ny")
        large = materialise(sketch.filter("fine is not null").select("f", "fine"), "fine")
        left, right = large.select(F.col("f").alias("x"), F.col("fine").alias("fx")), large.select(F.col("f").alias("y"), F.col("fine").alias("fy"))
        apart = F.aggregate(F.zip_with("fx", "fy", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0).cast("long"), lambda a, x: a + x)
        refused = (F.size("fx") == F.size("fy")) & (apart * (100 + self.threshold) > most)
        near = near.join(left, "x", "left").join(right, "y", "left").filter(~F.coalesce(refused, F.lit(False)))
        return near.select("x", "y")

    def tiled(self, rows: DataFrame, group: str) -> DataFrame:
        """Rows of ``group, f, ..., size, total`` dealt to tiles: pairs of blocks of about TILE sets or TILE_TOKENS shingles."""
        blocks = F.greatest(F.floor(F.col("size") / TILE), F.floor(F.col("total") / TILE_TOKENS)).cast("int") + 1
        rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("f", group), F.col("blocks")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return rows.withColumn("tile", F.xxhash64(group, F.least("block", "other"), F.greatest("block", "other")))

    def sketch_bytes(self, sketch: DataFrame) -> int:
        return sketch.agg(F.sum(8 * (SKETCH + 2) + F.when(F.col("fine").isNull(), 0).otherwise(8 * F.size("fine")))).first()[0] or 0

    def near_clusters(self, placed: DataFrame) -> DataFrame:
        """``f, c, cluster``: sets that have a near one in another component, by clusters of near components."""
        threshold = self.threshold
        involved = materialise(placed.select("f").distinct(), "nodes")
        sketch = materialise(self.sketched(involved), "sketched")
        tiles = self.tiled(placed, "key").select("tile", "block", "f", "n", "c")
        if self.sketch_bytes(sketch) <= BROADCAST_BYTES:
            tiles = tiles.repartition("tile").join(F.broadcast(sketch.drop("n")), "f")
        else:
            tiles = tiles.join(sketch.drop("n"), "f").repartition("tile")
        tiles = tiles.select("tile", "block", "f", "n", "c", *self.columns).sortWithinPartitions("tile")
        compare = self.compare
        found = materialise(tiles.mapInArrow(lambda it: near_rows(it, threshold, compare), "kind int, x long, y long").distinct(), "near")
        if found.isEmpty():
            return found.select(F.col("x").alias("f"), F.col("y").alias("c"), F.col("y").alias("cluster"))
        clusters = components(found.filter("kind = 1").select("x", "y"))
        members = found.filter("kind = 0").select(F.col("x").alias("f"), F.col("y").alias("c"))
        return materialise(members.join(small(clusters), F.col("c") == clusters["node"]).select("f", "c", F.col("component").alias("cluster")), "clusters")

    def cluster_links(self, clusters: DataFrame) -> DataFrame:
        """Links between components, one for each merge in a tile of sets of one cluster."""
        threshold = self.threshold
        sets = materialise(self.tokens(materialise(clusters.select("f").distinct(), "nodes")), "sets")
        rows = clusters.join(sets.select("f", F.size("tokens").alias("n")), "f")
        size = rows.groupBy("cluster").agg(F.count("*").alias("size"), F.sum("n").alias("total"))
        tiles = self.tiled(rows.join(size, "cluster"), "cluster").select("tile", "block", "f", "c")
        tiles = tiles.join(sets, "f").repartition("tile").sortWithinPartitions("tile").select("tile", "block", "f", "c", "tokens")
        return materialise(tiles.mapInArrow(lambda it: merge_rows(it, threshold), "x long, y long").distinct(), "links")

    def parts(self) -> DataFrame | None:
        """``node, component`` of the nodes that have links; None if there are none."""
        placed, links, parts = self.mixed(self.groups(), None), [], None
        for _ in range(HUB_ROUNDS):
            more = self.hub_links(placed, links)
            if more.isEmpty():
                break
            links.append(more)
            parts = components(all_of(links))
            placed = self.mixed(placed, parts)
        clusters = self.near_clusters(placed)
        if not clusters.isEmpty():
            more = self.cluster_links(clusters)
            if not more.isEmpty():
                links.append(more)
                parts = components(all_of(links))
        return parts


def jaccard_join(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, class_id, component_id``.

    Documents link if 100 * |intersection| >= threshold * |union| of their sets of k-word shingles. ``class_id`` is the
    smallest id with the same set, ``component_id`` the smallest id reachable by links.

    Edge cases: null, empty and blank texts have an empty set and link with nothing, each being a component of its own;
    texts of fewer than k words have one shingle; a row that repeats an id gives a row of its own, by its own text; a null id
    gets its size and no class or component, and links nothing; an empty table gives an empty table; columns besides
    ``doc_id`` and ``text`` are ignored.

    Shingles are equal if their 64-bit hashes are. Two sets of 20,000 shingles that share none meet a false one with a chance
    of 2e-11; that a set of a hundred million documents is taken for another has a chance of 3e-4 in all.
    """
    return classes(Join(docs, k, threshold))


def classes(join: Join) -> DataFrame:
    """``doc_id, n_shingles, class_id, component_id`` of all documents of a join."""
    parts = join.parts()
    known = join.nodes.filter("doc_id is not null").select("f", F.col("doc_id").alias("class_id"))
    if parts is None:
        found = known.withColumn("component_id", F.col("class_id"))
    else:
        least = small(known.join(small(parts), F.col("f") == parts["node"]).groupBy("component").agg(F.min("class_id").alias("least")))
        named = small(parts.join(least, "component").select(F.col("node").alias("f"), "least"))
        found = known.join(named, "f", "left").select("f", "class_id", F.coalesce("least", "class_id").alias("component_id"))
    rows = join.rows.select("doc_id", "n", F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("f")).alias("f"))
    out = rows.join(small(materialise(found, "found"), 24), "f", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), k=4, threshold=85).select("doc_id", "n_shingles", "component_id")


ORACLE_SQL = None  # links close over components, which plain SQL reaches only by recursion over all pairs
