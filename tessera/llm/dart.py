"""Near-duplicate detection by DartMinHash signatures, banding and exact verification.

A text is the multiset of its shingles of five words.  Darts are thrown into each shingle's region, which is as high
as its weight (its count) and reaches along a rank axis: a region's unit cells hold Poisson(1) darts, whose number,
place and coordinate come from hashes.  Of the darts below the weight, each of the coordinates keeps the earliest.
Two texts agree in a coordinate with probability equal to their weighted Jaccard similarity.  Bands of coordinates
give buckets; what meets in a bucket is verified on whole texts.

Equal texts are one vertex from the start.  What is wanted are connected components, so a pair need not be verified once
its texts have one label, and none is refused by an estimate.  Texts that buckets chain together go to one task if they
are at most BLOCK.  Of a longer chain, each text first goes to the largest of its buckets, cut into blocks; then, for some
rounds, the texts outside a bucket's largest label are held against a hundred of those inside.  All this costs a few
copies of each text.  What is left open then is settled exactly: the texts outside the largest label are held against all
others that share a bucket with them, by chain or by bucket, whichever moves fewer texts.  So a group of near copies costs
in proportion to its texts, and only texts that meet in a bucket but are not linked cost more: each is held against all
in that bucket.  Shared shingles of all pairs of two blocks are counted at once as a product of 0/1 matrices.

Defined results: texts are equal if their words are, so a null text equals one without words; a text of fewer than five
words is one shingle; a class is a connected component of links (similarity >= threshold), named by its smallest doc_id
(nulls last), and that document stays (of rows repeated with that id, one); an empty table gives no rows; columns but
doc_id and text are not read, whatever their names.  A text is held whole by one worker, and a block has at most BLOCK
texts and, beyond a first text, some ROOM shingles, so memory follows from these and the longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, attach, mixed, row_key, saved, small_batches, to_batch, union, without

WORDS, THRESHOLD, BANDS, ROWS = 5, 0.8, 32, 8
#: Texts in a block, and shingles in one at most if its texts are long; columns of a matrix.
BLOCK, ROOM, COLUMNS = 256, 1 << 19, 4096
#: Edges that a task contracts at once (some 100 MB).
LOCAL = 1 << 20
#: Shingles that are hashed at once.
PIECE = 1 << 16
#: Rounds that hold the texts outside a bucket's largest label against some inside, at most; how many inside.
ROUNDS, INSIDE = 4, 128
U = np.uint64


class Shingles:
    """Distinct shingle hashes of a text, with their counts."""

    def __init__(self, words: int = WORDS) -> None:
        self.words, self.rolling = words, Rolling()

    def normal(self, text: str | None) -> bytes:
        return b" ".join((text or "").encode("utf-8", "surrogatepass").split())

    def of(self, normal: bytes) -> tuple[np.ndarray, np.ndarray]:
        if not normal:
            return np.zeros(0, U), np.zeros(0, np.int64)
        data = np.frombuffer(normal, np.uint8)
        gaps = np.flatnonzero(data == 32)
        lo, hi = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(data)]])
        w = min(self.words, len(lo))
        lo, hi, out = lo[: len(lo) - w + 1], hi[w - 1 :], []
        for i in range(0, len(lo), PIECE):  # hashes do not depend on where a piece begins
            a, z = lo[i : i + PIECE], hi[i : i + PIECE]
            out.append(self.rolling.hashes(self.rolling.prefix(data[a[0] : z[-1]]), a - a[0], z - a[0]))
        return np.unique(np.concatenate(out), return_counts=True)

    def each(self, text: str | None) -> np.ndarray:
        """A hash for each shingle and how often it came before, so that shared counts are shared elements."""
        h, n = self.of(self.normal(text))
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return mixed(np.repeat(h, n) + nth.astype(U) * U(0x9E3779B97F4A7C15))


class DartMinHash:
    def __init__(self, coordinates: int) -> None:
        self.k = coordinates
        chance = np.exp(-1) / np.cumprod(np.concatenate([[1.0], np.arange(1, 20)]))
        self.poisson = np.cumsum(chance)  # number of darts in a unit cell, from a uniform draw

    def darts(self, keys: np.ndarray, units: np.ndarray, room: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and ranks of the darts of rank blocks first..last-1.  room: how much of each unit is below the weight."""
        block = np.arange(first, last, dtype=U)
        cell = mixed(mixed(keys + units * U(0x9E3779B97F4A7C15))[:, None] + block * U(0xC2B2AE3D27D4EB4F)).ravel()
        number = np.searchsorted(self.poisson, (cell >> U(11)) * 2.0**-53)
        dart = np.repeat(np.arange(len(cell)), number)
        nth = np.arange(len(dart)) - np.repeat(np.cumsum(number) - number, number)
        ids = mixed(cell[dart] + (nth + 1).astype(U) * U(0xD6E8FEB86659FD93))
        rank = first + dart % len(block) + (mixed(ids) >> U(11)) * 2.0**-53
        if (room < 1).any():
            below = (mixed(ids ^ U(0x5851F42D4C957F2D)) >> U(11)) * 2.0**-53 < room[dart // len(block)]
            ids, rank = ids[below], rank[below]
        return ids, rank

    def signature(self, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The earliest dart of each coordinate."""
        out, earliest = np.zeros(self.k, U), np.full(self.k, np.inf)
        height = np.ceil(weights).astype(np.int64)
        units = (np.arange(height.sum()) - np.repeat(np.cumsum(height) - height, height)).astype(U)
        room = np.minimum(1.0, np.repeat(weights, height) - units)
        keys = np.repeat(keys, height)
        first, last = 0, max(1, int(np.ceil(self.k * (np.log(self.k) + 3) / weights.sum())))
        while np.isinf(earliest).any():
            ids, rank = self.darts(keys, units, room, first, last)
            at = (ids % U(self.k)).astype(np.int64)
            np.minimum.at(earliest, at, rank)
            won = rank == earliest[at]
            out[at[won]] = ids[won]
            first, last = last, 2 * last
        return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    part = mixed(signature.reshape(bands, rows) + np.arange(1, rows + 1, dtype=U) * U(0xA0761D6478BD642F)).sum(1, dtype=U)
    return mixed(part + np.arange(bands, dtype=U) * U(0xE7037ED1A0B428DB)).view(np.int64)


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, words: int = WORDS) -> DataFrame:
    """doc_id, key (see row_key), content (of its words), weight (shingles), bands."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("content", pa.binary()), ("weight", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def work(batches):
        shingles, darts = Shingles(words), DartMinHash(bands * rows)
        for b in batches:
            content, weight, keys = [], [], []
            for text in b.column(2).to_pylist():
                normal = shingles.normal(text)
                h, n = shingles.of(normal)
                content.append(xxhash.xxh3_128_digest(normal))
                weight.append(int(n.sum()))
                keys.append(band_keys(darts.signature(h, n.astype(float)), bands, rows) if len(h) else [])
            yield to_batch(schema, {"doc_id": b.column(0), "key": b.column(1), "content": content, "weight": weight, "bands": keys})

    return docs.select(F.col("doc_id").cast("long"), row_key().alias("key"), "text").mapInArrow(work, "doc_id long, key long, content binary, weight long, bands array<long>")


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of a shares with each of b; if b is a, what only one set has is left out."""
    every, at = np.unique(np.concatenate([*a, *([] if b is a else b)]), return_inverse=True)
    n, out, sides = sum(map(len, a)), np.zeros((len(a), len(b)), np.int64), []
    shared = np.bincount(at, minlength=len(every)) > 1 if b is a else (np.bincount(at[:n], minlength=len(every)) > 0) & (np.bincount(at[n:], minlength=len(every)) > 0)
    number = np.cumsum(shared) - 1
    for sets, own in ((a, at[:n]), (b, at if b is a else at[n:])):
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[shared[own]]
        column = number[own[shared[own]]]
        order = np.argsort(column, kind="stable")
        sides.append((len(sets), row[order], column[order]))
    total = int(shared.sum())
    for first in range(0, total, COLUMNS):
        width, parts = min(COLUMNS, total - first), []
        for height, row, column in sides:
            lo, hi = np.searchsorted(column, [first, first + width])
            m = np.zeros((height, width), np.float32)
            m[row[lo:hi], column[lo:hi] - first] = 1
            parts.append(m)
        out += (parts[0] @ parts[1].T).astype(np.int64)
    return out


def linked(a: list[tuple], b: list[tuple], band: int, threshold: float) -> list[tuple[int, int]]:
    """v, least (vertex that links lead to) of the texts (v, label, bands, elements) of two blocks, or of one twice.

    Pairs count that share a band and have two labels; if a band is given, that they share it and none before.
    """
    x, y = (np.array([t[2] for t in side], np.int64) for side in (a, b))
    meet = np.zeros((len(a), len(b)), bool)
    for k in range(x.shape[1] if band < 0 else band):
        meet |= x[:, k, None] == y[:, k]
    if band >= 0:
        meet = ~meet & (x[:, band, None] == y[:, band])
    m, n = (np.array([len(t[3]) for t in side])[:, None] for side in (a, b))
    meet &= np.minimum(m, n.T) >= threshold * np.maximum(m, n.T) - 1e-9  # no other ratio can reach the threshold
    p, q = (np.array([t[1] for t in side]) for side in (a, b))
    meet &= p[:, None] != q
    rows, columns = np.flatnonzero(meet.any(1)), np.flatnonzero(meet.any(0))
    if not len(rows):
        return []
    left = [a[i][3] for i in rows]
    both = overlaps(left, left if b is a else [b[j][3] for j in columns])
    links = meet[np.ix_(rows, columns)] & (both >= threshold * (m[rows] + n[columns].T - both) - 1e-9)
    v, w, none = np.array([a[i][0] for i in rows]), np.array([b[j][0] for j in columns]), np.iinfo(np.int64).max
    p, q, before = v, w, None
    while before is None or (p != before[0]).any() or (q != before[1]).any():
        before = p, q
        p = np.minimum(p, np.where(links, q, none).min(1))
        q = np.minimum(q, np.where(links, p[:, None], none).min(0))
    out = dict(zip(w.tolist(), q.tolist())) | dict(zip(v.tolist(), p.tolist()))
    return [(k, least) for k, least in out.items() if k != least]


PLACE = ["g", "band", "i", "j"]


def all_links(placed: DataFrame, threshold: float, words: int) -> DataFrame:
    """u, v: links between the texts of each block (g, band, i, j), those of side 0 against side 1 if both are there.

    placed: PLACE, side, v, label, bands, text; rows repeated in a block count once.
    """
    schema = pa.schema([(c, pa.int64()) for c in ("u", "v")])

    def work(batches):
        shingles, run, held, out = Shingles(words), None, ({}, {}), []

        def ended():
            a, b = (list(side.values()) for side in held)
            return linked(a, b or a, run[1], threshold) if a else []

        for batch in batches:
            for *at, side, v, label, bands, text in zip(*(c.to_pylist() for c in batch.columns)):
                if at != run:
                    out += ended() if run else []
                    run, held = at, ({}, {})
                if v not in held[side]:
                    held[side][v] = (v, label, bands, shingles.each(text))
            if len(out) > 1000:
                yield to_batch(schema, dict(zip(schema.names, zip(*out))))
                out = []
        out += ended() if run else []
        if out:
            yield to_batch(schema, dict(zip(schema.names, zip(*out))))

    many = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.select(*PLACE, "side", "v", "label", "bands", "text").repartition(many, *PLACE).sortWithinPartitions(*PLACE)
    return dealt.mapInArrow(work, "u long, v long")


def parts_of(n, weight, block: int = 0):
    """Blocks for n texts of so many shingles in all."""
    return F.ceil(F.greatest(F.lit(1), F.col(n) / (block or BLOCK), F.col(weight) / ROOM)).cast("int")


def dealt_to(parts, seed: int):
    return F.pmod(F.xxhash64(F.lit(seed), "v"), F.col(parts)).cast("int")


def upto(n):
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def summed(rows: DataFrame) -> DataFrame:
    """Of rows (g, v, label, weight): g, giant (its largest label), n, total (weight), m, m_total of what has other labels, where there are such."""
    labels = rows.groupBy("g", "label").agg(F.count("*").alias("n"), F.sum("weight").alias("total"))
    giant = F.max(F.struct("n", "label", "total")).alias("giant")
    sums = labels.groupBy("g").agg(giant, F.sum("n").alias("n"), F.sum("total").alias("total"))
    rest = [(F.col("n") - F.col("giant.n")).alias("m"), (F.col("total") - F.col("giant.total")).alias("m_total")]
    return sums.select("g", F.col("giant.label").alias("giant"), "n", "total", *rest).filter("m > 0")


def near_labels(docs: DataFrame, signed: DataFrame, members: DataFrame, n_rows: int, threshold: float, words: int) -> DataFrame:
    """u, label: components of the links between texts (see components).  members: key, band, v, n (texts) of each bucket of several texts."""
    chains = components(members.select(F.col("v").alias("u"), F.col("lo").alias("v"))).withColumnsRenamed({"u": "v"})
    picks = members.groupBy("v").agg(F.max(F.struct("n", "key"))["key"].alias("pick"))
    own = signed.select(F.col("row").alias("v"), F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "weight", "bands").join(picks, "v").join(chains, "v", "left")
    own = saved(own.withColumn("chain", F.coalesce("label", "v")).drop("label"), "vertices")
    sizes = saved(own.groupBy("chain").agg(F.count("*").alias("n"), F.sum("weight").alias("total")).withColumn("large", (F.col("n") > BLOCK) | (F.col("total") > ROOM)), "chains")
    spots = attach(own.select("v", "chain", "pick", "weight"), sizes, "chain", "n", n_rows).withColumn("g", F.when(F.col("large"), F.col("pick")).otherwise(F.col("chain")))
    spots = saved(spots.select("v", "chain", "g", "weight", "large"), "grouped")
    met = docs.join(own.hint("merge"), (row_key() == own["__key"]) & docs["doc_id"].eqNullSafe(own["__id"]))
    texts = saved(met.select("v", "bands", "text"), "texts")  # of all that meets, moved once by the same plan at every size
    groups = saved(spots.groupBy("g").agg(F.count("*").alias("n"), F.sum("weight").alias("total")).withColumn("parts", parts_of("n", "total")).filter("n > 1"), "groups")
    first = attach(spots, groups, "g", "n", n_rows).select("g", "v", F.col("v").alias("label"), dealt_to("parts", 0).alias("i")).withColumns({"band": F.lit(-1), "j": F.lit(0), "side": F.lit(0)})
    edges = saved(all_links(first.join(texts.hint("merge"), "v"), threshold, words), "links")
    large = spots.filter("large").select("v", "chain", "g", "weight")
    labels = components(edges)
    if large.isEmpty():
        return labels

    def labelled(some: DataFrame) -> DataFrame:
        return some.join(labels.withColumnRenamed("u", "v"), "v", "left").withColumn("label", F.coalesce("label", "v"))

    open_ = None
    for k in range(1, ROUNDS + 1):
        now = saved(labelled(large), "labelled")
        groups = saved(summed(now).withColumn("parts", parts_of("m", "m_total", BLOCK - INSIDE)), "open_groups")
        before, open_ = open_, groups.agg(F.sum("m")).first()[0] or 0
        if not open_ or before and open_ > 0.7 * before:
            break
        met = attach(now, groups, "g", "n", n_rows)
        outside = met.filter("label <> giant").select("g", "v", "label", dealt_to("parts", k).alias("i"))
        chosen = F.pmod(F.xxhash64(F.lit(-k), "v"), F.col("n") - F.col("m")) < INSIDE
        inside = met.filter("label = giant").filter(chosen).select("g", "v", "label", upto("parts").alias("i"))
        placed = outside.unionByName(inside).withColumns({"band": F.lit(-1), "j": F.lit(0), "side": F.lit(0)})
        edges = edges.unionByName(saved(all_links(placed.join(texts.hint("merge"), "v"), threshold, words), "links"))
        labels = components(edges)
    now = saved(labelled(large), "labelled")

    def planned(rows: DataFrame) -> DataFrame:
        return summed(rows).withColumns({"all_parts": parts_of("n", "total"), "parts": parts_of("m", "m_total")}).withColumn("cost", F.col("n") * F.col("parts") + F.col("m") * F.col("all_parts"))

    by_chain = saved(planned(now.withColumn("g", F.col("chain"))), "open_chains")
    if by_chain.isEmpty():
        return labels
    held = saved(members.select("key", "band", "v").join(now.select("v", "label", "weight", "chain"), "v").withColumnRenamed("key", "g"), "held")
    by_bucket = saved(planned(held), "open_buckets")
    where = held.select("g", "chain").distinct()
    costs = by_bucket.join(where, "g").groupBy("chain").agg(F.sum("cost").alias("other"))
    cheap = saved(by_chain.join(costs.withColumnRenamed("chain", "g"), "g").select("g", (F.col("cost") <= F.col("other")).alias("whole")), "cheap")
    whole = by_chain.join(cheap.filter("whole"), "g", "left_semi")
    split = by_bucket.join(where.join(cheap.filter("not whole").select(F.col("g").alias("chain")), "chain", "left_semi"), "g", "left_semi")
    met = attach(now.withColumn("g", F.col("chain")).select("g", F.lit(-1).alias("band"), "v", "label"), whole, "g", "n", n_rows)
    met = met.unionByName(attach(held.select("g", "band", "v", "label"), split, "g", "n", n_rows))
    met = saved(met.withColumns({"one": F.col("all_parts") == 1, "mine": dealt_to("parts", -1), "other": dealt_to("all_parts", -2)}), "met")
    at = ["g", "band", "v", "label"]
    placed = union([
        met.filter("one").select(*at, F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side")),
        met.filter("not one and label <> giant").select(*at, F.col("mine").alias("i"), upto("all_parts").alias("j"), F.lit(0).alias("side")),
        met.filter("not one").select(*at, upto("parts").alias("i"), F.col("other").alias("j"), F.lit(1).alias("side")),
    ])
    return components(edges.unionByName(saved(all_links(placed.join(texts.hint("merge"), "v"), threshold, words), "links")))


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each vertex to the smallest one of its component, of these edges alone."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, label = at[: len(u)], at[len(u) :], np.arange(len(names))
    while True:
        p, q = label[a], label[b]
        if (p == q).all():
            break
        least = np.minimum(p, q)
        np.minimum.at(label, p, least)
        np.minimum.at(label, q, least)
        while (label != (label := label[label])).any():
            pass
    own = label != np.arange(len(names))
    return names[own], names[label[own]]


def contract(edges: DataFrame, parts: int = 0) -> DataFrame:
    """The edges with the same components in fewer ones: each task contracts LOCAL of its own at a time."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def work(batches):
        held, n = [], 0
        for b in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
            n += b.num_rows
            if n > LOCAL:
                yield to_batch(schema, dict(zip("uv", contracted(*map(np.concatenate, zip(*held))))))
                held, n = [], 0
        if n:
            yield to_batch(schema, dict(zip("uv", contracted(*map(np.concatenate, zip(*held))))))

    few = edges.select("u", "v")
    return (few.coalesce(parts) if parts else few).mapInArrow(work, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """u, label (the smallest vertex of its component) of the edges (u, v), for all u but the smallest.

    Tasks contract their own edges; what more than one task holds is then joined by large-star and small-star rounds.
    Minima are written before they are joined, so that a hub's edges can be split over tasks.
    """
    edges = saved(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v"), "edges")
    if edges.count() <= LOCAL:
        return saved(contract(edges, 1), "labels").withColumnRenamed("v", "label")
    edges = saved(contract(edges).distinct(), "contracted")
    while True:
        # done once each vertex has one edge, to a vertex without a smaller one
        several = edges.groupBy("u").count().filter("count > 1").select("u")
        middle = edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u")
        if several.unionByName(middle).isEmpty():
            return edges.withColumnRenamed("v", "label")
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = saved(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = saved(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = saved(small.filter("u <> v").distinct(), "small")


def classes_of(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, words: int = WORDS) -> DataFrame:
    """doc_id, class_id, class_size, kept, key (see row_key), for every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = saved(signatures(docs, bands, rows, words).withColumn("row", F.monotonically_increasing_id()), "signatures")
    n_rows = signed.count()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    groups = saved(signed.groupBy("content").agg(first.alias("f"), F.count("*").alias("copies")).select("content", F.col("f.row").alias("v"), F.col("f.doc_id").alias("first_id"), "copies"), "contents")
    keyed = signed.select("row", F.posexplode("bands").alias("band", "key")).join(groups.select(F.col("v").alias("row")), "row", "left_semi").select("key", "band", F.col("row").alias("v"))
    buckets = saved(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("lo")).filter("n > 1"), "buckets")
    members = saved(keyed.join(buckets.hint("merge"), "key"), "members")
    labels = None if members.isEmpty() else near_labels(docs, signed, members, n_rows, threshold, words).withColumnRenamed("u", "v")
    classes = groups.join(labels, "v", "left") if labels else groups.withColumn("label", F.col("v"))
    classes = saved(classes.select("content", "v", "first_id", "copies", F.coalesce("label", "v").alias("label")), "classes")
    top = F.min(F.struct(F.col("first_id").isNull().alias("no_id"), "first_id", "v"))
    heads = saved(classes.groupBy("label").agg(top.alias("t"), F.sum("copies").alias("class_size"), F.count("*").alias("texts")).select("label", F.col("t.first_id").alias("class_id"), F.col("t.v").alias("stays"), "class_size", "texts"), "heads")
    full = saved(attach(classes, heads, "label", "texts", n_rows).select("content", "copies", "class_id", "stays", "class_size"), "full")
    out = attach(signed.select("doc_id", "key", "row", "content"), full, "content", "copies", n_rows)
    return out.select("doc_id", "class_id", "class_size", (F.col("row") == F.col("stays")).alias("kept"), "key")


def near_classes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id, class_size, kept, for every row."""
    return classes_of(docs, **options).drop("key")


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay, with all their columns; a row goes if another of its class stays."""
    return without(docs, classes_of(docs, **options), "near_gone")
