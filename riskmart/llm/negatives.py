"""Hard negatives by angular triangle filtering.

Every row keeps its norm and its angles to a few reference directions. The angle
between two rows lies between the largest difference and the smallest sum of their
angles to one direction, so the norms times the cosines of these bounds enclose their
inner product; a slack covers rounding. Rows lie in sectors (nearest
direction, band of the angle to it), whose bounds are tried first. Only pairs whose
interval meets the wanted window of scores get an integer inner product.

Anchors meet rows in blocks: packs of anchors are sent to the parts of the
sectors that may matter to one of them, and every block gives back its best few per anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskmart.llm.shipping import ship
from riskmart.llm.tables import stored

REFERENCES, BANDS = 16, 16
#: Rows of which the directions and bands are chosen; results don't depend on them.
SAMPLE_ROWS = 2048
#: Rows of a block, anchors of a pack, and rows for which a sector gets another part.
BLOCK_ROWS, PACK_ROWS, PART_ROWS = 1024, 128, 8192
#: Angles are kept in single precision; arc cosines are less exact near 0 and pi.
ANGLE_SLACK, SCORE_SLACK = 4e-6, 1e-9
LOWEST, HIGHEST = -(1 << 62), 1 << 62

_PACKED = "n int, dim int, width int, ids binary, labels binary, anchors binary, vectors binary, norms binary, angles binary"
_INDEX_BITS = 10


class Rows:
    """Some vectors with what the filter needs."""

    def __init__(self, keys, ids, labels, vectors, norms, angles) -> None:
        self.keys, self.ids, self.labels, self.vectors, self.norms, self.angles = keys, ids, labels, vectors, norms, angles

    def take(self, rows: np.ndarray) -> Rows:
        return Rows(*(x[rows] for x in (self.keys, self.ids, self.labels, self.vectors, self.norms, self.angles)))

    @staticmethod
    def joined(parts: list[Rows]) -> Rows:
        dim = max(p.vectors.shape[1] for p in parts)
        vectors = np.concatenate([padded(p.vectors, dim) for p in parts])
        rest = lambda name: np.concatenate([getattr(p, name) for p in parts])
        return Rows(rest("keys"), rest("ids"), rest("labels"), vectors, rest("norms"), rest("angles"))


def padded(vectors: np.ndarray, dim: int) -> np.ndarray:
    return np.pad(vectors, ((0, 0), (0, max(0, dim - vectors.shape[1]))))


def narrow(vectors: np.ndarray) -> np.ndarray:
    """The smallest integer type that holds all components."""
    low, high = (int(vectors.min()), int(vectors.max())) if vectors.size else (0, 0)
    for kind in (np.int16, np.int32):
        if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max:
            return vectors.astype(kind)
    return vectors.astype(np.int64)


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one column, missing components at the end being zero."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def measured(vectors: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and angles to each reference direction; a zero vector is at right angles to all."""
    dim = max(vectors.shape[1], references.shape[1])
    floats = padded(vectors, dim).astype(float)
    norms = np.sqrt((floats**2).sum(axis=1))
    cosines = (floats / np.maximum(norms, 1e-300)[:, None]) @ padded(references, dim).T
    return norms, np.arccos(np.clip(cosines, -1, 1)).astype(np.float32)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products; scores beyond a long are an error."""
    dim = max(a.shape[1], b.shape[1])
    a, b = padded(a, dim), padded(b, dim)
    largest = lambda x: max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0
    bound = largest(a) * largest(b) * max(dim, 1)
    if bound < 1 << 53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if bound < 1 << 63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return (a.astype(object) @ b.astype(object).T).astype(np.int64)


def cosine_range(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest cosine between directions a and any whose angles lie from low to high, each with each."""
    near = np.zeros((len(a), len(low)), np.float32)
    far = np.full((len(a), len(low)), np.pi, np.float32)
    for k in range(a.shape[1]):
        own = a[:, k : k + 1]
        near = np.maximum(near, np.maximum(low[:, k] - own, own - high[:, k]))
        far = np.minimum(far, np.minimum(own + high[:, k], np.float32(2 * np.pi) - own - low[:, k]))
    near = np.clip(near - ANGLE_SLACK, 0, np.pi)
    far = np.clip(far + ANGLE_SLACK, 0, np.pi)
    return np.cos(far.astype(float)), np.cos(near.astype(float))


def score_range(norm: np.ndarray, least: np.ndarray, most: np.ndarray, cosines: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the scores of rows with these norms, safe against rounding."""
    low, high = cosines
    norm = norm[:, None]
    upper = norm * np.where(high > 0, most, least) * high
    lower = norm * np.where(low > 0, least, most) * low
    slack = norm * most * SCORE_SLACK + 1
    return lower - slack, upper + slack


class Sectors:
    """Directions, bands, and the bounds of the rows of each sector: at most REFERENCES x BANDS of them."""

    def __init__(self, sample: np.ndarray) -> None:
        floats = sample.astype(float)
        norms = np.sqrt((floats**2).sum(axis=1))
        unit = floats[norms > 0] / norms[norms > 0][:, None]
        if not len(unit):
            unit = np.eye(1, max(sample.shape[1], 1))
        chosen, closest = [0], unit @ unit[0]
        while len(chosen) < min(REFERENCES, len(unit)):  # always the one farthest from those chosen
            chosen.append(int(closest.argmin()))
            closest = np.maximum(closest, unit @ unit[chosen[-1]])
        self.references = unit[chosen]
        _, angles = measured(sample, self.references)
        self.edges = np.quantile(angles.min(axis=1), np.arange(1, BANDS) / BANDS).astype(np.float32)
        self.names = self.low = self.high = self.least = self.most = self.parts = np.zeros(0)

    def of(self, angles: np.ndarray) -> np.ndarray:
        return angles.argmin(axis=1) * (len(self.edges) + 1) + np.searchsorted(self.edges, angles.min(axis=1))

    def bounded(self, found: list) -> None:
        self.names = np.array([r.sector for r in found])
        self.low, self.high = (np.array([r[c] for r in found], np.float32).reshape(len(found), -1) for c in ("low", "high"))
        self.least, self.most = (np.array([r[c] for r in found], float) for c in ("least", "most"))
        self.parts = np.array([-(-r.n // PART_ROWS) for r in found])

    def reached(self, anchors: Rows, low: np.ndarray, high: np.ndarray) -> list[tuple[int, int]]:
        """(sector, part) of all sectors that may hold a score from low to high for one of the anchors."""
        lower, upper = score_range(anchors.norms, self.least, self.most, cosine_range(anchors.angles, self.low, self.high))
        meets = ((upper >= low[:, None]) & (lower <= high[:, None])).any(axis=0)
        return [(int(self.names[s]), part) for s in np.flatnonzero(meets) for part in range(int(self.parts[s]))]


def pack(rows: Rows, anchors: np.ndarray) -> tuple:
    vectors = narrow(rows.vectors)
    body = (rows.ids, rows.labels, anchors.astype(np.int8), vectors, rows.norms.astype(float), rows.angles.astype(np.float32))
    return (len(rows.ids), vectors.shape[1], vectors.itemsize, *(x.tobytes() for x in body))


def unpack(row: dict, keys: np.ndarray) -> tuple[Rows, np.ndarray]:
    n, kind = row["n"], {2: np.int16, 4: np.int32, 8: np.int64}[row["width"]]
    read = lambda name, kind: np.frombuffer(row[name], kind)
    vectors = read("vectors", kind).reshape(n, row["dim"])
    rows = Rows(keys, read("ids", np.int64), read("labels", np.int64), vectors, read("norms", float), read("angles", np.float32).reshape(n, -1))
    return rows, read("anchors", np.int8).astype(bool)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)


_PACK_NAMES = [f.split()[0] for f in _PACKED.split(", ")]
_PACK_KINDS = [pa.int32()] * 3 + [pa.binary()] * 6


def find_sectors(rows: DataFrame) -> Sectors | None:
    """Directions by a bounded sample of SAMPLE_ROWS rows (smallest hashes of vec_id), bounds by all rows."""
    sample = [r.vector for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").select("vector").limit(SAMPLE_ROWS).collect()]
    if not sample:
        return None
    sectors = Sectors(matrix(pa.array(sample, pa.list_(pa.int64()))))

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norms, angles = measured(matrix(batch.column("vector")), sectors.references)
            home = sectors.of(angles)
            out = []
            for sector in np.unique(home).tolist():
                own = home == sector
                out.append((sector, int(own.sum()), norms[own].min(), norms[own].max(), angles[own].min(axis=0).tolist(), angles[own].max(axis=0).tolist()))
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.float32()), pa.list_(pa.float32())]
            yield _batch(out, ["sector", "n", "least", "most", "low", "high"], kinds)

    each = rows.select("vector").mapInArrow(bounds, "sector long, n long, least double, most double, low array<float>, high array<float>")
    ends = [F.array(*[f(F.col(c)[k]) for k in range(len(sectors.references))]).alias(c) for c, f in (("low", F.min), ("high", F.max))]
    found = each.groupBy("sector").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), *ends)
    sectors.bounded(sorted(found.collect(), key=lambda r: r.sector))
    return sectors


def in_blocks(rows: DataFrame, sectors: Sectors) -> DataFrame:
    """Rows of a sector's part together, BLOCK_ROWS at most; a row's key is its block's number and its place there."""
    parts = dict(zip(sectors.names.tolist(), sectors.parts.tolist(), strict=True))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, angles = measured(matrix(batch.column("vector")), sectors.references)
            home = sectors.of(angles)
            spread = batch.column("spread").to_numpy() % np.array([parts[s] for s in home.tolist()], np.int64)
            columns = [pa.array(home.astype(np.int64)), pa.array(spread), *[batch.column(c) for c in ("vec_id", "label", "anchor", "vector")]]
            yield pa.RecordBatch.from_arrays(columns, names=["sector", "part", "vec_id", "label", "anchor", "vector"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count, current, number = 0, None, 0

        def block() -> pa.RecordBatch:
            nonlocal held, count, number
            table = pa.Table.from_batches(held).combine_chunks()
            vectors = matrix(table.column("vector").chunk(0))
            norms, angles = measured(vectors, sectors.references)
            ids, labels = (table.column(c).to_numpy() for c in ("vec_id", "label"))
            body = pack(Rows(ids, ids, labels, vectors, norms, angles), table.column("anchor").to_numpy())
            out = _batch([(*current, (current[0] << 44) + (current[1] << 20) + number, *body)], ["sector", "part", "block", *_PACK_NAMES], [pa.int64()] * 3 + _PACK_KINDS)
            held, count, number = [], 0, number + 1
            return out

        for batch in batches:
            sector, part = (batch.column(c).to_numpy() for c in ("sector", "part"))
            change = np.flatnonzero((np.diff(sector) != 0) | (np.diff(part) != 0)) + 1
            for first, last in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows], strict=True):
                if first == last:
                    continue
                here = (int(sector[first]), int(part[first]))
                if here != current:
                    if count:
                        yield block()
                    current, number = here, 0
                while first < last:
                    upto = min(last, first + BLOCK_ROWS - count)
                    held.append(batch.slice(first, upto - first))
                    count += upto - first
                    first = upto
                    if count == BLOCK_ROWS:
                        yield block()
        if count:
            yield block()

    keyed = rows.withColumn("spread", F.xxhash64("vec_id").bitwiseAND((1 << 62) - 1))
    put = keyed.mapInArrow(placed, "sector long, part long, vec_id long, label long, anchor boolean, vector array<long>")
    together = put.repartition("sector", "part").sortWithinPartitions("sector", "part", "vec_id", "label", "vector")
    return stored(together.mapInArrow(packed, f"sector long, part long, block long, {_PACKED}"), "vector-blocks")


def _keys(block: int, n: int) -> np.ndarray:
    return (np.int64(block) << _INDEX_BITS) + np.arange(n)


def anchor_packs(blocks: DataFrame, positives: int) -> DataFrame:
    """Packs of anchors (pack, keys, floors): an anchor's floor is the score its own block gives for the last positive."""

    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[Rows, np.ndarray]] = []

        def emit() -> pa.RecordBatch:
            rows, floors = Rows.joined([r for r, _ in held]), np.concatenate([f for _, f in held])
            out = []
            for first in range(0, len(rows.ids), PACK_ROWS):
                part = rows.take(np.arange(first, min(first + PACK_ROWS, len(rows.ids))))
                body = pack(part, np.ones(len(part.ids), bool))
                out.append((int(part.keys[0]), part.keys.tobytes(), floors[first : first + PACK_ROWS].tobytes(), *body))
            held.clear()
            return _batch(out, ["pack", "keys", "floors", *_PACK_NAMES], [pa.int64(), pa.binary(), pa.binary(), *_PACK_KINDS])

        for batch in batches:
            for row in batch.to_pylist():
                rows, anchors = unpack(row, _keys(row["block"], row["n"]))
                if not anchors.any():
                    continue
                own = rows.take(np.flatnonzero(anchors))
                scores = inner(own.vectors, rows.vectors)
                scores[(own.labels[:, None] != rows.labels) | (own.keys[:, None] == rows.keys)] = LOWEST
                best = -np.sort(-scores, axis=1)[:, :positives]
                floors = best[:, -1] if best.shape[1] == positives else np.full(len(best), LOWEST)
                held.append((own, floors))
                if sum(len(r.ids) for r, _ in held) >= PACK_ROWS:
                    yield emit()
        if held:
            yield emit()

    return stored(blocks.drop("sector", "part").mapInArrow(packs, f"pack long, keys binary, floors binary, {_PACKED}"), "anchor-packs")


def meeting(packs: DataFrame, blocks: DataFrame, sectors: Sectors, windows) -> DataFrame:
    """Each pack beside each block of the sectors it reaches; `windows(row)` gives the scores (low, high) its anchors want."""
    extra = [c for c in packs.columns if c not in _PACK_NAMES]

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.to_pylist()):
                rows, _ = unpack(row, np.frombuffer(row["keys"], np.int64))
                reached = sectors.reached(rows, *windows(row))
                for first in range(0, len(reached), 64):
                    some = reached[first : first + 64]
                    copies = batch.take(pa.array([i] * len(some)))
                    columns = [pa.array([s for s, _ in some], pa.int64()), pa.array([p for _, p in some], pa.int64()), *copies.columns]
                    yield pa.RecordBatch.from_arrays(columns, names=["sector", "part", *batch.schema.names])

    spread = packs.mapInArrow(sent, f"sector long, part long, {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in packs.schema)}")
    named = blocks.select("sector", "part", "block", *[F.col(c).alias(f"b_{c}") for c in _PACK_NAMES])
    return spread.join(named.hint("merge"), ["sector", "part"]).select("block", *extra, *_PACK_NAMES, *[f"b_{c}" for c in _PACK_NAMES])


def both_sides(row: dict) -> tuple[Rows, Rows]:
    anchors, _ = unpack(row, np.frombuffer(row["keys"], np.int64))
    rows, _ = unpack({c: row[f"b_{c}"] for c in _PACK_NAMES}, _keys(row["block"], row["b_n"]))
    return anchors, rows


def scored(anchors: Rows, rows: Rows, wanted: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Integer scores where the bounds meet the window and `wanted` allows; the second array says where."""
    bounds = score_range(anchors.norms, rows.norms, rows.norms, cosine_range(anchors.angles, rows.angles, rows.angles))
    mask = wanted & (bounds[1] >= low[:, None]) & (bounds[0] <= high[:, None])
    some, others = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    scores = np.full(mask.shape, LOWEST)
    if len(some):
        scores[np.ix_(some, others)] = inner(anchors.vectors[some], rows.vectors[others])
    return scores, mask & (scores >= low[:, None]) & (scores <= high[:, None])


def best_of(scores: np.ndarray, ids: np.ndarray, keys: np.ndarray, count: int) -> np.ndarray:
    return np.lexsort((keys, ids, -scores))[:count]


_MATCHES = "pack long, slot int, anchor_id long, bound long, id long, key long, score long"
_MATCH_NAMES = [f.split()[0] for f in _MATCHES.split(", ")]
_MATCH_KINDS = [pa.int64(), pa.int32(), *[pa.int64()] * 5]


def find_positives(packs: DataFrame, blocks: DataFrame, sectors: Sectors, count: int) -> DataFrame:
    """(pack, slot, anchor_id, id, key, score, rank): the best other rows of an anchor's label."""

    def floors(row: dict) -> tuple[np.ndarray, np.ndarray]:
        low = np.frombuffer(row["floors"], np.int64)
        return low, np.full(len(low), HIGHEST)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                anchors, rows = both_sides(row)
                same = (anchors.labels[:, None] == rows.labels) & (anchors.keys[:, None] != rows.keys)
                scores, mask = scored(anchors, rows, same, *floors(row))
                out = []
                for slot in np.flatnonzero(mask.any(axis=1)).tolist():
                    found = np.flatnonzero(mask[slot])
                    for r in found[best_of(scores[slot, found], rows.ids[found], rows.keys[found], count)].tolist():
                        out.append((row["pack"], slot, int(anchors.ids[slot]), 0, int(rows.ids[r]), int(rows.keys[r]), int(scores[slot, r])))
                yield _batch(out, _MATCH_NAMES, _MATCH_KINDS)

    found = meeting(packs, blocks, sectors, floors).mapInArrow(score, _MATCHES)
    order = Window.partitionBy("pack", "slot").orderBy(F.col("score").desc(), "id", "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def find_negatives(packs: DataFrame, blocks: DataFrame, sectors: Sectors, positives: DataFrame, count: int, low: int, high: int) -> DataFrame:
    """(pack, slot, bound, id, key, score, rank): the best rows of other labels per window of a positive's score `bound`."""
    asked = positives.groupBy("pack").agg(F.collect_set(F.struct("slot", "score")).alias("asked"))  # PACK_ROWS x positives at most

    def ends(score: int) -> tuple[int, int]:
        return -(-low * score // 100), high * score // 100

    def windows(row: dict) -> tuple[np.ndarray, np.ndarray]:
        least, most = np.full(row["n"], HIGHEST), np.full(row["n"], LOWEST)
        for x in row["asked"]:
            a, b = ends(x["score"])
            if a <= b:
                least[x["slot"]], most[x["slot"]] = min(least[x["slot"]], a), max(most[x["slot"]], b)
        return least, most

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                anchors, rows = both_sides(row)
                other = anchors.labels[:, None] != rows.labels
                scores, mask = scored(anchors, rows, other, *windows(row))
                out = []
                for x in row["asked"]:
                    slot, (a, b) = x["slot"], ends(x["score"])
                    found = np.flatnonzero(mask[slot] & (scores[slot] >= a) & (scores[slot] <= b))
                    for r in found[best_of(scores[slot, found], rows.ids[found], rows.keys[found], count)].tolist():
                        out.append((row["pack"], slot, int(anchors.ids[slot]), x["score"], int(rows.ids[r]), int(rows.keys[r]), int(scores[slot, r])))
                yield _batch(out, _MATCH_NAMES, _MATCH_KINDS)

    found = meeting(packs.drop("floors").join(asked, "pack"), blocks, sectors, windows).mapInArrow(score, _MATCHES)
    order = Window.partitionBy("pack", "slot", "bound").orderBy(F.col("score").desc(), "id", "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def hard_negatives(rows: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every anchor and positive.

    `rows` has vec_id, label, vector (integers) and anchor (boolean). A score
    is an integer inner product, missing components being zero; higher comes first,
    then the smaller vec_id, then the row's place. An anchor's positives are its best
    other rows of the same label; its negatives are the best rows of other labels from
    low to high percent of a positive's score. Rows with a NULL vec_id, label, vector or
    component take no part, nor do empty windows (negative scores of positives).
    Repeated rows are rows of their own, each anchor among them with its own result.
    Scores beyond a long are an error. Extra columns are ignored; an empty table gives no rows.
    """
    spark = rows.sparkSession
    ship(spark)
    whole = F.forall("vector", lambda x: x.isNotNull())
    kept = rows.where("vec_id is not null and label is not null and vector is not null").where(whole)
    kept = kept.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.coalesce("anchor", F.lit(False)).alias("anchor"), F.col("vector").cast("array<long>"))
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    sectors = find_sectors(kept)
    if sectors is None:
        return spark.createDataFrame([], schema)
    blocks = in_blocks(kept, sectors)
    packs = anchor_packs(blocks, positives)
    good = stored(find_positives(packs, blocks, sectors, positives), "positives")
    bad = find_negatives(packs, blocks, sectors, good, negatives, low, high)
    chosen = good.select("pack", "slot", F.col("score").alias("bound"), "anchor_id", F.col("id").alias("positive_id"))
    both = chosen.join(bad.drop("anchor_id"), ["pack", "slot", "bound"])
    return both.select(
        "anchor_id",
        "positive_id",
        F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("negative_id"),
        F.col("bound").alias("positive_score"),
        F.col("score").alias("negative_score"),
    )
