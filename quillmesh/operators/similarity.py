"""Similar messages and vectors: exact set-similarity pairs, cosine pairs, and their clusters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions import text as tx
from quillmesh.session import dropped, kept, small_batches


#: Items in this share of all places, or in more, come last of all: there are fewer of them than its inverse.
_FREQUENT = 1 / 1_000
_PLACES = 28  # bits of the places at most that say whether an item occurs twice: 32 MB, and half as much for how often
_EARLIER = 3  # items before it that a row of a prefix has with it, where many sets are much alike
_BLOCK_SETS = 2_000  # sets of a unit that a task holds at once, twice over
_ROWS = 8  # cells that a vector is dealt to, on an average
_BLOCK_CELLS = 50  # a block of vectors that a task holds is at most so many times a cell as it is meant to be
_FEW_PAIRS = 50_000  # candidates that aren't worth making sketches of all sets
_FEW_ROWS = 2_000_000  # rows of two longs that are broadcast, some 100 MB at the most; more are shuffled


def jaccard_pairs(sets: DataFrame, threshold: float, key: str = "id", items: str = "shingles") -> DataFrame:
    """(a, b, similarity) of all pairs of sets at or above threshold, a < b, in sets(id, items). Keys are distinct longs; empty
    and null sets are like none.

    Items stand for their 64-bit hashes (longs for themselves), so of different items with one hash a set counts one. Prefix
    filtering: with items in a common order, two sets that are similar enough share an item among the first
    n - ceil(threshold * n) + 1 of each. Rare items come first: all are counted, by places that their hashes fall on (see
    _counted), and what has a place to itself needs no partner looked for. So few rows of prefixes are joined by item; a pair
    goes on only if it can still share enough after the item's places in both, and only from an item that no common one comes shortly
    before in both, so that sets that are much alike don't meet once an item. Sets meet
    for verification in units (see _meet), so that a group of copies moves as often as it has blocks, not pairs; most candidates
    fall by sketches before that (see _sketches), and only sets of the others move.
    """
    hashed = _hashed(sets, key, items).where(F.size("items") > 0)
    ready = _prefixes(hashed, threshold, _counted(hashed))
    return _verified(_candidates(ready, ready, threshold), hashed, _sketches(hashed), threshold)


def few(rows: DataFrame) -> bool:
    """Whether rows of one or two longs are so few that they are broadcast."""
    return rows.count() <= _FEW_ROWS


def _hashed(sets: DataFrame, key: str, items: str) -> DataFrame:
    """(id, items) of the sets, items as distinct longs, none for null; written once."""
    plain = dict(sets.dtypes)[items] == "array<bigint>"
    values = F.array_distinct(F.col(items) if plain else F.transform(items, lambda x: F.xxhash64(x)))
    return kept(sets.select(F.col(key).cast("long").alias("id"), F.coalesce(values, F.array().cast("array<bigint>")).alias("items")), "jaccard-sets")


def _mixed(items):
    """Items of a numpy array as unsigned numbers whose first bits are even."""
    import numpy as np

    return items.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _flat(batch):
    """All items of a batch of sets, and the number of each set's."""
    import numpy as np

    return batch.column("items").flatten().to_numpy(), np.diff(batch.column("items").offsets.to_numpy())


def _counted(hashed: DataFrame):
    """How often items occur, broadcast: (bits, levels), both by the first bits of mixed items. A bit says whether any item of its place
    occurs twice; a level bounds how often one of its place does, as a power of two, where that is twice or more.

    Items are told apart by 24 bits beyond their part, which are what is shuffled, three bytes an item. Two that fall together count as one, so
    numbers are too large at the worst. There are places enough for two an item, up to 2^_PLACES."""
    import numpy as np
    import pyarrow as pa

    small_batches(hashed.sparkSession)
    total = hashed.agg(F.sum(F.size("items"))).first()[0] or 0
    wide = min(_PLACES, max(18, (2 * total).bit_length()))
    cut = wide - 18  # bits of a part's number; a part has 2^18 places
    last = max(1.0, total * _FREQUENT)

    def deal(batches):
        for batch in batches:
            own = np.sort(_mixed(_flat(batch)[0]) >> np.uint64(64 - cut - 24))
            ends = np.searchsorted(own, np.arange(1, (1 << cut) + 1, dtype=np.uint64) << np.uint64(24))
            data = own.astype(np.uint32).view(np.uint8).reshape(-1, 4)[:, :3]
            starts = np.append(0, ends[:-1])
            parts = np.flatnonzero(ends > starts)
            yield pa.RecordBatch.from_pydict({"part": pa.array(parts.astype(np.int32)), "low": pa.array([data[starts[k] : ends[k]].T.tobytes() for k in parts], pa.binary())})

    def count(table: pa.Table) -> pa.Table:
        low = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8).reshape(3, -1) for x in table.column("low")], axis=1).astype(np.uint32)
        items, n = np.unique(low[0] | low[1] << np.uint32(8) | low[2] << np.uint32(16), return_counts=True)
        items, n = items[n > 1], n[n > 1]
        bits, levels = np.zeros(1 << 18, np.uint8), np.zeros(1 << 14, np.uint8)
        bits[items >> np.uint32(6)] = 1
        if len(items):
            at = items >> np.uint32(10)
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            levels[at[first]] = np.maximum.reduceat(np.where(n > last, 64, np.ceil(np.log2(n))), first).astype(np.uint8)
        return pa.table({"part": table.column("part").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary()), "levels": pa.array([levels.tobytes()], pa.binary())})

    found = hashed.select("items").mapInArrow(deal, "part int, low binary").groupBy("part").applyInArrow(count, "part int, bits binary, levels binary")
    bits, levels = np.zeros((1 << cut, 1 << 15), np.uint8), np.zeros((1 << cut, 1 << 14), np.uint8)
    for r in found.collect():  # 48 MB at the most
        bits[r.part], levels[r.part] = np.frombuffer(r.bits, np.uint8), np.frombuffer(r.levels, np.uint8)
    return hashed.sparkSession.sparkContext.broadcast((bits.ravel(), levels.ravel()))


def _prefixes(hashed: DataFrame, threshold: float, counted, earlier: int = _EARLIER) -> DataFrame:
    """(id, n, place, item, e1, ...): of each set of n items the first ones in the common order, as many as a pair must share one of,
    without those that occur once; with each, `earlier` items before it that this leaves, the nearest first, null where there are no more."""
    import numpy as np
    import pyarrow as pa

    def prefixes(batches):
        bits, levels = counted.value
        wide = (8 * len(bits)).bit_length() - 1
        for batch in batches:
            flat, sizes = _flat(batch)
            row = np.repeat(np.arange(len(sizes)), sizes)
            place = (_mixed(flat) >> np.uint64(64 - wide)).astype(np.int64)
            twice = (bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
            once = sizes - np.bincount(row[twice], minlength=len(sizes))  # these come first, and meet no other set
            most = sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + 1
            twice &= (most > once)[row]
            flat, row, level = flat[twice], row[twice], levels[place[twice] >> 4]
            order = np.lexsort((flat, level, row))
            starts = np.searchsorted(row, np.arange(len(sizes)))
            nth = np.arange(len(flat)) - starts[row]
            take = np.flatnonzero(nth + once[row] < most[row])
            item, of, nth = flat[order][take], row[take], nth[take]
            out = {"id": batch.column("id").to_numpy()[of], "n": sizes[of].astype(np.int32), "place": (nth + once[of]).astype(np.int32), "item": item}
            for k in range(1, earlier + 1):  # a set's rows are the first of it, so they stand together
                out[f"e{k}"] = pa.array(np.append(np.zeros(min(k, len(item)), np.int64), item[:-k]), mask=nth < k)
            yield pa.RecordBatch.from_pydict(out)

    more = "".join(f", e{k} long" for k in range(1, earlier + 1))
    return hashed.select("id", "items").mapInArrow(prefixes, "id long, n int, place int, item long" + more)


def _candidates(left: DataFrame, right: DataFrame, threshold: float, ordered: bool = True) -> DataFrame:
    """Distinct (a, b), a of left and b of right, a < b if `ordered`, that share an item of their prefixes and can share enough after it.
    They meet at the first such item, and at others only if none of the items shortly before is one."""
    a, b = left.alias("a"), right.alias("b")
    least = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("a.n") + F.col("b.n")) - 1e-9)
    can = F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place")) >= least
    before = reduce(lambda x, y: x | y, [F.col(f"a.{x}") == F.col(f"b.{y}") for x in left.columns for y in right.columns if x[0] == y[0] == "e"], F.lit(False))
    near = (F.col("a.item") == F.col("b.item")) & ((F.col("a.id") < F.col("b.id")) if ordered else F.lit(True)) & (F.col("a.n") >= F.lit(threshold) * F.col("b.n")) & (F.col("b.n") >= F.lit(threshold) * F.col("a.n")) & can & ~F.coalesce(before, F.lit(False))
    return kept(a.join(b, near).groupBy(F.col("a.id").alias("a"), F.col("b.id").alias("b")).agg(F.lit(1).alias("one")).select("a", "b"), "jaccard-candidates")


def _sketches(hashed: DataFrame) -> DataFrame:
    """(id, n, bits): of each set of n items 2 n to 4 n bits, a power of two; a bit tells whether an odd number of items falls on it.
    Bits in which two sets differ are no more than the items in which they do. Written once, a thirtieth or so of the sets."""
    import numpy as np
    import pyarrow as pa

    def sketch(batches):
        for batch in batches:
            items = batch.column("items")
            ends = items.offsets.to_numpy().astype(np.int64)
            flat = items.values.to_numpy()
            n = np.diff(ends)
            wide = np.maximum(64, 1 << np.ceil(np.log2(2 * n)).astype(np.int64))
            at = 0
            while at < len(n):
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + (1 << 20), side="right")) - 1)
                own = wide[at:to]
                starts = np.cumsum(own) - own
                mixed = (flat[ends[at] : ends[to]].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
                where = np.repeat(starts, n[at:to]) + (mixed.astype(np.int64) & np.repeat(own - 1, n[at:to]))
                odd = np.bincount(where, minlength=int(own.sum())) & 1
                data = np.packbits(odd.astype(np.uint8), bitorder="little")
                offsets = np.append(starts, own.sum()) // 8
                bits = pa.Array.from_buffers(pa.binary(), to - at, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
                yield pa.RecordBatch.from_pydict({"id": batch.column("id").slice(at, to - at), "n": pa.array(n[at:to].astype(np.int32)), "bits": bits})
                at = to

    return kept(hashed.mapInArrow(sketch, "id long, n int, bits binary"), "jaccard-sketches")


def _verified(pairs: DataFrame, sets: DataFrame, sketches: DataFrame | None, threshold: float) -> DataFrame:
    """(a, b, similarity) of those candidate pairs(a, b) of sets(id, items), each in one order only, that reach the threshold. The sketches meet first,
    and leave out what differs in too many bits; the sets of the rest are compared, without sketches those of all. With them, pairs are deleted."""
    import numpy as np

    def possible(x, y):
        (n, p), (m, q) = x, y
        while len(p) > len(q):
            p = p[: len(p) // 2] ^ p[len(p) // 2 :]
        while len(q) > len(p):
            q = q[: len(q) // 2] ^ q[len(q) // 2 :]
        shared = (n + m - int(np.bitwise_count(p ^ q).sum())) // 2
        return shared / (n + m - shared) if shared >= threshold * (n + m - shared) - 1e-9 else None

    def similarity(x, y):
        if len(x) > len(y):
            x, y = y, x
        shared = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
        return shared / (len(x) + len(y) - shared) if shared >= threshold * (len(x) + len(y) - shared) else None

    def drawn(batch):
        n, bits = batch.column("n").to_pylist(), batch.column("bits")
        return lambda k: (n[k], np.frombuffer(bits[k].as_buffer(), np.uint64))

    def listed(batch):
        items = batch.column("items")
        return lambda k: np.sort(items[k].values.to_numpy())

    if sketches is None:
        return _meet(pairs, sets, listed, similarity)[0]
    met, used = _meet(pairs, sketches, drawn, possible)
    near = kept(met.select("a", "b"), "jaccard-near")
    dropped(pairs, *used)
    return _meet(near, sets, listed, similarity)[0]


def _meet(pairs: DataFrame, sets: DataFrame, read, compare) -> tuple[DataFrame, list[DataFrame]]:
    """(a, b, similarity) of those pairs(a, b) that compare() gives one, and the tables that this reads. sets has an id and
    columns of which read(batch) makes what is compared, by row.

    A pair's unit is the least candidate of its smaller id, itself included, so that a group whose members are all candidates
    of each other is one unit. Each set goes once to a unit that has pairs of it; units of many sets are cut into
    pairs of blocks. A task holds two blocks and streams their pairs.
    """
    import pyarrow as pa

    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("unit"))
    placed = kept(pairs.join(lowest, "a").select("unit", "a", "b"), "jaccard-placed")
    sizes = placed.select("unit", F.explode(F.array("a", "b")).alias("id")).distinct().groupBy("unit").agg(F.ceil(F.count("*") / _BLOCK_SETS).cast("int").alias("blocks"))
    block = lambda c: F.pmod(F.xxhash64(F.lit("block"), c), F.col("blocks")).cast("int")
    i, j = block("a"), block("b")
    tiles = kept(placed.join(sizes, "unit").select(F.xxhash64("unit", F.least(i, j), F.greatest(i, j)).alias("tile"), "a", "b"), "jaccard-tiles")
    dropped(placed)
    needed = kept(tiles.select("tile", F.explode(F.array("a", "b")).alias("id")).distinct(), "jaccard-needed")
    held = [c for c in sets.columns if c != "id"]
    rows = (F.broadcast(needed) if few(needed) else needed).join(sets, "id").select("tile", F.lit(0).alias("role"), F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), *held)
    rows = rows.unionByName(tiles.select("tile", F.lit(1).alias("role"), "a", "b"), allowMissingColumns=True)

    def check(batches):
        at, held = None, {}
        for batch in batches:
            a, b, role, tile = batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("role").to_pylist(), batch.column("tile").to_pylist()
            own = read(batch)
            found = [], [], []
            for k, t in enumerate(tile):
                if t != at:
                    at, held = t, {}
                if role[k] == 0:
                    held[a[k]] = own(k)
                    continue
                value = compare(held[a[k]], held[b[k]])
                if value is not None:
                    for out, x in zip(found, (a[k], b[k], value)):
                        out.append(x)
            yield pa.RecordBatch.from_pydict({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64()), "similarity": pa.array(found[2], pa.float64())})

    return rows.repartition("tile").sortWithinPartitions("tile", "role").mapInArrow(check, "a long, b long, similarity double"), [tiles, needed]


def leader_clusters(sets: DataFrame, threshold: float, key: str = "id", items: str = "shingles", parts: int | None = None) -> DataFrame:
    """(id, leader): walking the sets by ascending id, one joins the first earlier leader of at least that similarity, else it
    leads. One row an id; empty and null sets lead themselves.

    Ids are walked in ranges, each seven times as large as all before: a range first meets the leaders so far, of lower ids all, and
    joins the least like it. Only what is left, and so is near no earlier leader, is compared among itself and walked
    (see leaders). A group of copies is thus pairs of its leader with each, not of all with all, but for the range it first
    shows up in. Ranges' ends are approximate quantiles, on which only the speed depends, as it does on their number `parts`: by
    itself as many as leave some thousand sets in the first, four at the most.
    """
    whole = _hashed(sets, key, items)
    hashed = whole.where(F.size("items") > 0)
    if parts is None:
        parts, first = 1, hashed.count()
        while parts < 4 and first > 4000:
            parts, first = parts + 1, first // 8
    ready = kept(_prefixes(hashed, threshold, _counted(hashed)), "leader-prefixes")
    sketches: list[DataFrame] = []

    def near(left: DataFrame, right: DataFrame) -> DataFrame:
        pairs = _candidates(left, right, threshold)
        if pairs.count() > _FEW_PAIRS and not sketches:
            sketches.append(_sketches(hashed))
        return _verified(pairs, hashed, sketches[0] if sketches else None, threshold)

    ends = hashed.agg(F.percentile_approx("id", [8.0**-k for k in range(parts - 1, 0, -1)], 1000)).first()[0] or []
    ends = [None, *sorted(set(ends)), None]
    done, led = [], []
    for low, high in zip(ends, ends[1:]):
        within = (F.lit(True) if low is None else F.col("id") > low) & (F.lit(True) if high is None else F.col("id") <= high)
        own, rest = ready.where(within), hashed.where(within).select("id")
        if led:
            found = kept(near(reduce(DataFrame.unionByName, led), own).groupBy(F.col("b").alias("id")).agg(F.min("a").alias("leader")), "leader-found")
            done.append(found)
            rest = rest.join(found, "id", "left_anti")
            own = kept(own.join(found, "id", "left_anti"), "leader-open")
        walked = kept(leaders(near(own, own).select("a", "b"), rest), "leader-walked")
        done.append(walked)
        if high is not None:
            led.append(kept(own.join(walked.where("id = leader").select("id"), "id", "left_semi"), "leader-prefixes"))
        dropped(own)
    dropped(ready, *led, *sketches)
    empty = whole.where(F.size("items") == 0).select("id", F.col("id").alias("leader"))
    return reduce(DataFrame.unionByName, [*done, empty])


def leaders(pairs: DataFrame, ids: DataFrame, rounds: int = 8, walk_pairs: int = 1 << 18) -> DataFrame:
    """(id, leader): walking ids upwards, one joins the first earlier leader it is similar to, else it leads. One row an id.

    The walk depends only on pairs: an id without smaller neighbours leads, an id with a leading smaller neighbour follows the
    least of them, and one whose smaller neighbours all follow leads. Settled ids are found in rounds of joins; a round
    settles all that can be, the least open id at least. Long chains alone need many, so after `rounds` rounds, and each
    time that they have doubled, the open components of at most `walk_pairs` pairs are walked in a task each; rounds go on for
    larger ones until no id is open. No more pairs than that in all are walked at once.
    """
    pairs = kept(pairs.select("a", "b"), "leader-pairs")
    if pairs.count() <= walk_pairs:
        walked = kept(pairs.select("a", "b", F.lit(None).cast("boolean").alias("led")).groupBy().applyInPandas(_walk, "id long, leader long"))
        if not pairs.where("a >= b").isEmpty() or not walked.join(ids, "id", "left_anti").isEmpty():
            raise ValueError("pairs must be of ids, the smaller first")
        return walked.unionByName(ids.join(walked.select("id"), "id", "left_anti").select("id", F.col("id").alias("leader")))
    settled = [kept(ids.join(pairs.select(F.col("b").alias("id")).distinct(), "id", "left_anti").select("id", F.col("id").alias("leader")))]
    open_ = _marked(pairs.select("a", "b", F.lit(None).cast("boolean").alias("led")), settled[0])
    n = 0
    while True:
        by = open_.groupBy("b").agg(F.min(F.when(F.col("led"), F.col("a"))).alias("follows"), F.min(F.when(F.col("led").isNull(), F.col("a"))).alias("blocked"))
        done = kept(by.where("blocked is null or follows < blocked").select(F.col("b").alias("id"), F.coalesce("follows", "b").alias("leader")))
        if done.isEmpty():
            break
        settled.append(done)
        open_ = _replaced(open_, _marked(open_, done))
        n += 1
        if n == rounds:
            rounds *= 2
            done = kept(_walked(open_, walk_pairs))
            settled.append(done)
            open_ = _replaced(open_, _marked(open_, done))
        if len(settled) > 16:
            settled = [_replaced(*settled, kept(reduce(DataFrame.unionByName, settled), "leader-settled"))]
    if not open_.isEmpty():
        raise ValueError("pairs must be of ids, the smaller first")
    return reduce(DataFrame.unionByName, settled)


def _replaced(*frames: DataFrame) -> DataFrame:
    """The last of the tables, whose making was the last use of the others."""
    dropped(*frames[:-1])
    return frames[-1]


def _marked(open_: DataFrame, done: DataFrame) -> DataFrame:
    """Pairs whose larger id is still open; led says whether the smaller one leads, null while that is open too."""
    rest = open_.join(done.select(F.col("id").alias("b")), "b", "left_anti")
    marks = done.select(F.col("id").alias("a"), (F.col("leader") == F.col("id")).alias("now"))
    return kept(rest.join(marks, "a", "left").select("a", "b", F.coalesce("led", "now").alias("led")), "leader-open")


def _walk(pdf):
    """(id, leader) of the ids of pairs(a, b, led), without those known to be settled, as a pandas frame."""
    import pandas as pd

    pdf = pdf.sort_values(["b", "a"])
    own: dict[int, int] = {}
    for a, b, led in zip(pdf.a.tolist(), pdf.b.tolist(), pdf.led.tolist()):
        if own.setdefault(b, b) == b and (own.setdefault(a, a) == a if led is None else led):
            own[b] = a
    return pd.DataFrame({"id": list(own), "leader": list(own.values())})


def _walked(open_: DataFrame, most: int) -> DataFrame:
    """(id, leader) of the open ids in components of at most `most` open pairs, walked in order."""
    root = components(open_.where("led is null"), open_.select(F.col("b").alias("id")).distinct())
    rooted = open_.join(root.select(F.col("id").alias("b"), "root"), "b")
    small = rooted.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("root")
    return rooted.join(small, "root", "left_semi").groupBy("root").applyInPandas(_walk, "id long, leader long")


def _unit_rows(vectors):
    """Vectors of an Arrow array as unit rows of float64; those of length zero stay zero."""
    import numpy as np

    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(vectors), -1) if len(vectors) else flat.reshape(0, 1)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _spread(sample, n: int):
    """n of the sample's vectors, as unit rows: the first, then always the one farthest from all taken; fewer if it has no more."""
    import numpy as np

    m = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    taken, closest = [0], m @ m[0]
    while len(taken) < n and (far := int(closest.argmin())) not in taken and closest[far] < 1 - 1e-9:
        taken.append(far)
        closest = np.maximum(closest, m @ m[far])
    return m[taken]


def _visits(m, own, reach: float):
    """The nearest pivot of each unit row, and which of the later ones' cells it may have a partner in."""
    import numpy as np

    sims, gaps = m @ own.T, np.maximum(np.sqrt(np.maximum(0.0, 2 - 2 * own @ own.T)), 1e-300)
    home = sims.argmax(axis=1)
    guest = (sims[np.arange(len(home)), home][:, None] - sims) <= reach * gaps[home]
    guest &= np.arange(sims.shape[1]) > home[:, None]
    return home, guest


def cells(vectors: DataFrame, least: float, cell_rows: int = 2_000, most: int = 1_024, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v, cell, home): every vector in the cell of its nearest pivot (home), and as a guest in each later cell that may hold
    one of at least that cosine with it.

    Pivots are taken among the vectors of smallest hashed ids, each as far as can be from those before, one for some
    `cell_rows` vectors and `most` at the most; they are broadcast. Where cells rule out little, there are fewer of them: as few as
    a sampled vector needs for `_ROWS` rows at the most, or eight, so rows grow as the vectors do.
    Two unit vectors of that cosine are at most r = sqrt(2 - 2 least) apart. Whoever lives in cell j is on j's side of the plane
    midway between the pivots i and j, so a vector of cell i that is farther than r from that plane has no partner in j.
    """
    import numpy as np
    import pyarrow as pa

    kind = "float" if dict(vectors.dtypes)[vector] == "array<float>" else "double"
    rows = vectors.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast(f"array<{kind}>").alias("v"))
    wanted = min(most, max(8, -(-rows.count() // cell_rows)))
    chosen = rows.where(F.exists("v", lambda x: x != 0)).orderBy(F.xxhash64("id"), "id").limit(4 * wanted).collect()  # at most 4,096 vectors
    sample = np.array([r.v for r in chosen], np.float64)
    pivots = _spread(sample, wanted) if chosen else np.zeros((1, 1))
    reach = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-9
    if chosen:
        sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    while len(pivots) > 8 and 1 + _visits(sample, pivots, reach)[1].sum(axis=1).mean() > _ROWS:
        pivots = pivots[: max(8, len(pivots) // 2)]
    held = vectors.sparkSession.sparkContext.broadcast(pivots)

    def deal(batches):
        own = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                home, guest = _visits(_unit_rows(part.column("v")), own, reach)
                row, cell = np.nonzero(guest)
                take = np.concatenate([np.arange(len(home)), row])
                yield pa.RecordBatch.from_pydict({"id": part.column("id").take(pa.array(take)), "v": part.column("v").take(pa.array(take)), "cell": np.concatenate([home, cell]).astype(np.int32), "home": np.arange(len(take)) < len(home)})

    return rows.mapInArrow(deal, f"id long, v array<{kind}>, cell int, home boolean")


def _block_rows(dealt: DataFrame, cell_rows: int) -> int:
    """Vectors of a block: `_BLOCK_CELLS` cells' as they are meant to be, fewer where they are long, for some 64 MB of doubles."""
    longest = dealt.agg(F.max(F.size("v"))).first()[0] or 1
    return max(cell_rows, min(_BLOCK_CELLS * cell_rows, (8 << 20) // max(1, longest)))


def _units(dealt: DataFrame, block_rows: int, guest_rows: int, units: int = 32) -> DataFrame:
    """Rows of cells() as units of work (cell, block, run, role, ...): a cell above `block_rows` is cut into blocks of that size, and
    what comes to a block into runs of `guest_rows`; into more where cells are few, for some `units` in all. Role 0 is the block
    itself, 1 what streams past it."""
    fewest = -(-units // max(1, dealt.select("cell").distinct().count()))
    count = dealt.groupBy("cell").agg(F.count_if("home").alias("own"), F.count_if(~F.col("home")).alias("guests"))
    parts = kept(count.select("cell", F.greatest(F.lit(1), F.ceil(F.col("own") / block_rows)).cast("int").alias("blocks"), F.greatest(F.lit(fewest), F.ceil((F.col("own") + F.col("guests")) / guest_rows)).cast("int").alias("runs")), "cosine-parts")
    mine = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "id"), F.col(n)).cast("int")
    place = lambda block, run, role: F.struct(block.alias("block"), run.alias("run"), F.lit(role).alias("role"))
    every = lambda n, f: F.transform(F.sequence(F.lit(0), n), f)
    block, run = mine("block", "blocks"), mine("run", "runs")
    stays = every(F.col("runs") - 1, lambda r: place(block, r, 0))
    earlier = F.when(block > 0, every(F.greatest(block - 1, F.lit(0)), lambda b: place(b, run, 1))).otherwise(F.array().cast("array<struct<block:int,run:int,role:int>>"))
    visits = every(F.col("blocks") - 1, lambda b: place(b, run, 1))
    placed = dealt.join(F.broadcast(parts), "cell")  # a row a cell, of which there are at most 1,024
    units = placed.withColumn("p", F.explode(F.when(F.col("home"), F.concat(stays, earlier)).otherwise(visits)))
    out = units.select("cell", "p.block", "p.run", "p.role", *[c for c in dealt.columns if c not in ("cell", "home")])
    n = parts.agg(F.sum(F.col("blocks") * F.col("runs"))).first()[0] or 1  # by number, as units that are small in bytes still take long
    return out.repartition(min(4 * n, max(n, 2_000)), "cell", "block", "run").sortWithinPartitions("cell", "block", "run", "role")


def _meetings(batches, least: float, mark: str | None = None):
    """(left, right, near) of rows of _units(), each pair of vectors in one meeting: left and right are (ids, marks), near the
    matrix of pairs at or above `least`. A part of a block that meets itself has each of its pairs once, above the diagonal."""
    import numpy as np

    at, block = None, []
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("cell", "block", "run", "role")], axis=1)
        cuts = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1).tolist(), len(keys)]
        for s, e in [(k, min(k + 2048, e)) for s, e in zip(cuts, cuts[1:]) for k in range(s, e, 2048)]:
            unit, role = tuple(keys[s][:3].tolist()), int(keys[s][3])
            if unit != at:
                at, block = unit, []
            ids, m = batch.column("id").slice(s, e - s).to_numpy(), _unit_rows(batch.column("v").slice(s, e - s))
            marks = batch.column(mark).slice(s, e - s).to_numpy(zero_copy_only=False) if mark else ids
            if role == 1 or unit[2] == 0:
                for other in block:
                    yield other[:2], (ids, marks), other[2] @ m.T >= least, other[2], m
            if role == 0:
                if unit[2] == 0:
                    yield (ids, marks), (ids, marks), np.triu(m @ m.T >= least, 1), m, m
                block.append((ids, marks, m))


def cosine_pairs(vectors: DataFrame, least: float, cell_rows: int = 2_000, guest_rows: int = 200_000, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(a, b, cosine) of pairs at or above `least`, a < b. Exact; ids are distinct longs, null vectors are left out, and all
    vectors are of one length.

    Each vector meets those of its own pivot's cell and of the cells in reach (see cells), in units (see _units): a task holds a
    block as a matrix and streams the others past it. How much the cells save depends on the data: close pairs of clustered
    vectors meet in few cells; where `least` is low and vectors point everywhere, each must meet nearly all others.
    """
    import numpy as np
    import pyarrow as pa

    def compare(batches):
        for left, right, near, x, y in _meetings(batches, least):
            i, j = np.nonzero(near)
            a, b = left[0][i], right[0][j]
            yield pa.RecordBatch.from_pydict({"a": np.minimum(a, b), "b": np.maximum(a, b), "cosine": np.einsum("ij,ij->i", x[i], y[j])})

    dealt = kept(cells(vectors, least, cell_rows, key=key, vector=vector), "cosine-cells")
    return _units(dealt, _block_rows(dealt, cell_rows), guest_rows).mapInArrow(compare, "a long, b long, cosine double")


def dbscan_vectors(vectors: DataFrame, least: float, neighbours: int = 3, cell_rows: int = 2_000, guest_rows: int = 200_000, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, cluster, core) of DBSCAN over vectors whose cosine is at least `least`; as dbscan() of cosine_pairs(), without ever
    making the pairs.

    The cells are met three times: for each vector's number of neighbours; for edges that connect cores, of which a meeting
    gives one less than it connects at the most; and for the least cluster that a border vector reaches.
    """
    import numpy as np
    import pyarrow as pa

    dealt = kept(cells(vectors, least, cell_rows, key=key, vector=vector), "cosine-cells")
    block_rows = _block_rows(dealt, cell_rows)

    def degrees(batches):
        for left, right, near, *_ in _meetings(batches, least):
            for ids, n in ((left[0], np.count_nonzero(near, axis=1)), (right[0], np.count_nonzero(near, axis=0))):
                yield pa.RecordBatch.from_pydict({"id": ids[n > 0], "n": n[n > 0].astype(np.int64)})

    def links(batches):
        for left, right, near, *_ in _meetings(batches, least, "mark"):
            near = near & left[1].astype(bool)[:, None] & right[1].astype(bool)
            label, out = np.arange(len(near)), []
            where = {int(x): i for i, x in enumerate(left[0])} if left[0] is right[0] else {}
            for j in np.flatnonzero(near.any(axis=0)).tolist():
                own, first = np.unique(label[near[:, j]], return_index=True)
                touched = np.flatnonzero(near[:, j])[first]
                me = where.get(int(right[0][j]))
                if me is not None:  # a part of a block with itself: j is a row too
                    touched = touched[label[touched] != label[me]]
                    own = np.append(own, label[me])
                out += [(left[0][i], right[0][j]) for i in touched.tolist()]
                label[np.isin(label, own)] = own[0]
            ends = np.array(out, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_pydict({"a": ends.min(axis=1), "b": ends.max(axis=1)})

    def reached(batches):
        far = np.iinfo(np.int64).max
        for left, right, near, *_ in _meetings(batches, least, "mark"):
            i, j = np.nonzero(near)
            for (ids, own), (_, other), x, y in ((left, right, i, j), (right, left, j, i)):
                lowest = np.full(len(ids), far)
                np.minimum.at(lowest, x, other[y])
                take = (own == far) & (lowest < far)
                yield pa.RecordBatch.from_pydict({"id": ids[take], "cluster": lowest[take]})

    def met(run, schema, marks=None):
        rows = dealt if marks is None else dealt.join(marks, "id", "left").withColumn("mark", F.coalesce("mark", F.lit((1 << 63) - 1 if run is reached else 0)))
        return _units(rows, block_rows, guest_rows).mapInArrow(run, schema)

    everyone = dealt.where("home").select("id")
    n = met(degrees, "id long, n long").groupBy("id").agg((F.sum("n") + 1).alias("n"))
    cores = kept(everyone if neighbours <= 1 else n.where(F.col("n") >= neighbours).select("id"), "dbscan-cores")
    edges = kept(met(links, "a long, b long", cores.withColumn("mark", F.lit(1).cast("long"))), "dbscan-links")
    found = components(edges, cores)
    border = met(reached, "id long, cluster long", found.select("id", F.col("root").alias("mark"))).groupBy("id").agg(F.min("cluster").alias("cluster"))
    return found.select("id", F.col("root").alias("cluster"), F.lit(True).alias("core")).unionByName(border.select("id", "cluster", F.lit(False).alias("core")))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, root): the least id reachable over edges(a, b), by minima of all neighbours of a root's ids and
    pointer jumping until no root moves. Edges are written once, and a round's table goes when the next one is written."""
    both = kept(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "component-edges")
    state = nodes.select("id", F.col("id").alias("root"))
    last = None
    while True:
        near = both.join(state.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("m"))
        least = state.join(near, "id", "left").groupBy("root").agg(F.least("root", F.min(F.coalesce("m", "root"))).alias("up"))
        jump = least.join(least.select(F.col("root").alias("up"), F.col("up").alias("top")), "up").select("root", "top")
        now = kept(state.join(jump, "root").select("id", F.col("top").alias("root"), F.col("root").alias("was")), "components")
        if last is not None:
            dropped(last)
        if now.where("root <> was").isEmpty():
            dropped(both)
            return now.select("id", "root")
        last, state = now, now.select("id", "root")


def dbscan(pairs: DataFrame, nodes: DataFrame, least: int = 3) -> DataFrame:
    """(id, cluster, core) of pairs (a, b) within reach: ids with `least` neighbours, itself included, are cores; cores that
    reach each other are one cluster, named by its least core; others join the least cluster they reach; noise is left out.
    Pairs are computed once and written."""
    pairs = kept(pairs.select("a", "b"), "dbscan-pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy(F.col("a").alias("id")).agg((F.count("*") + 1).alias("degree"))
    cores = kept(nodes.select("id") if least <= 1 else degree.where(F.col("degree") >= least).select("id"), "dbscan-cores")
    ca, cb = cores.withColumnRenamed("id", "a"), cores.withColumnRenamed("id", "b")
    found = components(pairs.join(ca, "a", "left_semi").join(cb, "b", "left_semi"), cores)
    border = both.join(ca, "a", "left_anti").join(found.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("cluster"))
    return found.select("id", F.col("root").alias("cluster"), F.lit(True).alias("core")).unionByName(border.select("id", "cluster", F.lit(False).alias("core")))


def cluster_quality(clusters: DataFrame, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(cluster, n, avg_cosine): the mean cosine of a cluster's pairs, from the length of the sum of its unit vectors, so no
    pair is made: (|sum|^2 - n) / (n (n - 1))."""
    v = clusters.join(vectors, F.col("id") == F.col(key)).select("cluster", "id", F.posexplode(vector).alias("i", "x"), F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, y: s + y.cast("double") * y.cast("double"))).alias("norm"))
    sums = v.groupBy("cluster", "i").agg(F.sum(F.try_divide(F.col("x").cast("double"), F.col("norm"))).alias("s"))
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    total = sums.groupBy("cluster").agg(F.sum(F.col("s") * F.col("s")).alias("q")).join(sizes, "cluster")
    return total.select("cluster", "n", F.try_divide(F.col("q") - F.col("n"), F.col("n") * (F.col("n") - 1.0)).alias("avg_cosine"))


def _walked_means(rows, least: float, chunk: int = 256) -> list[int]:
    """The clusters of centroid_clusters() of the rows of a matrix, in their order.

    A chunk of rows meets the means so far in one product of matrices; those that the chunk moves or adds are met one by one.
    Means within rounding of the closest are measured again, each by itself, so that no result depends on the chunks.
    """
    import numpy as np

    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-300)
    exact = lambda v, m: float(v @ m / (np.linalg.norm(v) * np.linalg.norm(m) or 1.0))
    means, units, sizes, own = np.zeros((1024, rows.shape[1])), np.zeros((1024, rows.shape[1])), [], []
    for at in range(0, len(rows), chunk):
        part = rows[at : at + chunk]
        points = unit(part)
        known = points @ units[: len(sizes)].T
        moved: list[int] = []
        fresh = np.zeros_like(part)  # unit means of the moved ones, in that order
        for i, v in enumerate(part):
            sims = known[i], fresh[: len(moved)] @ points[i]
            top = np.max([x.max(initial=-np.inf) for x in sims])  # not a number if one is none
            close = []
            if top >= least - 1e-9:
                close = sorted([*np.flatnonzero(sims[0] >= top - 1e-9).tolist(), *(moved[j] for j in np.flatnonzero(sims[1] >= top - 1e-9).tolist())])
            values = [exact(v, means[j]) for j in close]
            k = close[int(np.argmax(values))] if values and max(values) >= least else len(sizes)
            if k == len(sizes):
                if k == len(means):
                    means, units = (np.concatenate([x, np.zeros_like(x)]) for x in (means, units))
                means[k] = v
                sizes.append(1)
            else:
                means[k] = (means[k] * sizes[k] + v) / (sizes[k] + 1)
                sizes[k] += 1
            units[k] = unit(means[k])
            if k not in moved:
                moved.append(k)
                if k < known.shape[1]:
                    known[:, k] = -np.inf
            fresh[moved.index(k)] = units[k]
            own.append(k)
    return own


def centroid_clusters(vectors: DataFrame, block: Column, least: float, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(block, id, cluster): in each block, in the order of ids, a vector joins the running mean it is closest to, if that is
    close enough, else it starts one. The order makes this sequential: blocks are its unit of work, to be kept small by their
    choice, and like vectors of two blocks never join. What a block takes grows with its vectors times its means, as products of
    matrices (see _walked_means)."""
    import numpy as np
    import pandas as pd

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        rows = np.array([np.asarray(v, float) for v in pdf.v]).reshape(len(pdf), -1)
        return pd.DataFrame({"block": pdf.block, "id": pdf.id, "cluster": _walked_means(rows, least)})

    return vectors.select(block.cast("long").alias("block"), F.col(key).alias("id"), F.col(vector).alias("v")).groupBy("block").applyInPandas(walk, "block long, id long, cluster long")


def nearest(rows: DataFrame, others: DataFrame, k: int = 3, steps: tuple[float, ...] = (0.9, 0.7, 0.5, 0.3)) -> DataFrame:
    """The k rows most like any of the others by token sets: (id, similarity). Exact.

    As k rows at or above a similarity settle the answer, the steps are tried from the highest: at each, only sets that share
    one of their rarest tokens (as many as that similarity requires, see jaccard_pairs) meet. Where no step finds k rows, the
    limit is halved until one does, or until it is below what sets of the largest sizes have that share one token. Rows
    that share no token with any of the others are never near.
    """
    own, other = _token_sets(rows.select("id", "text"), 0), _token_sets(others.select(F.lit(0).alias("id"), "text"), 1)
    w = Window.partitionBy("digest").orderBy("id", "no")
    placed = kept(own.select("digest", "id", "no").withColumn("place", F.row_number().over(w)).withColumn("first", F.first("no").over(w)).where(F.col("place") <= k).drop("digest"), "nearest-ids")
    a = own.join(placed.where("place = 1").select("no"), "no", "left_semi").select(F.col("no").alias("id"), "items")
    b = other.join(other.groupBy("digest").agg(F.min("no").alias("no")).select("no"), "no", "left_semi").select(F.col("no").alias("id"), "items")
    a, b = kept(a, "nearest-sets"), kept(b, "nearest-sets")
    both = a.unionByName(b)
    counted, sketches = _counted(both), _sketches(both)
    dropped(own, other)
    most = sum(x.agg(F.max(F.size("items"))).first()[0] or 0 for x in (a, b))
    steps = list(steps)
    for least in steps:
        pairs = _candidates(_prefixes(a, least, counted, 0), _prefixes(b, least, counted, 0), least, ordered=False)
        best = _verified(pairs, both, sketches, least).groupBy(F.col("a").alias("first")).agg(F.max("similarity").alias("similarity"))
        found = kept(best.join(placed, "first").select("id", "similarity").orderBy(F.desc("similarity"), "id").limit(k), "nearest-found")
        if found.count() == k or least * most < 1:
            break
        if least == steps[-1]:
            steps.append(least / 2)
    return found.orderBy(F.desc("similarity"), "id")


def _token_sets(rows: DataFrame, odd: int) -> DataFrame:
    """(id, no, digest, items) of the texts that have tokens: hashes of the tokens, a digest of all of them, and a number of the
    row's own, odd or even as asked for. Written once."""
    s = rows.select("id", tx.token_set(F.col("text")).alias("s")).where(F.size("s") > 0)
    digest = F.sha2(F.array_join("s", " ").cast("binary"), 256).alias("digest")
    items = F.array_distinct(F.transform("s", lambda x: F.xxhash64(x))).alias("items")
    return kept(s.select("id", (F.monotonically_increasing_id() * 2 + odd).alias("no"), digest, items), "nearest-texts")
