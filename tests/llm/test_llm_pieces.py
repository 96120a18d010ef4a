import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from riskmart.llm import pieces as P
from riskmart.llm.shipping import ship
from riskmart.llm.tables import discard, stored


def shared(spark, rows, size):
    """(doc_id, nth) -> (first document's row_key, occurrences), through pieces of `size` values."""
    ship(spark)

    def cut(batches):
        held = P.Pieces(P.MIN_BLOCKS)
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                values = np.array(one.column("v")[0].as_py(), np.int64).view(np.uint64)
                numbers = np.arange(len(values)) * 3
                yield from held.add(one.column("doc_id"), one.column("row_key"), np.array([len(values)]), values, numbers)
                if held.size >= size:
                    yield from held.rest()
        yield from held.rest()

    docs = spark.createDataFrame(rows, "row_key long, doc_id string, v array<long>").repartition(4)
    written = stored(docs.mapInArrow(cut, P.piece_schema("string")), "pieces-test")

    def result(found):
        return pa.table(
            {
                "row_key": found.keys.take(pa.array(found.owner)),
                "nth": found.nth,
                "three": found.rest[0],
                "head": found.head_keys.take(pa.array(found.first)),
                "copies": found.copies,
            }
        )

    got = P.answered(written, "string", result, "row_key long, nth long, three long, head long, copies long").collect()
    discard(written)
    assert all(r.three == 3 * r.nth for r in got) and len({(r.row_key, r.nth) for r in got}) == len(got)
    return {(r.row_key, r.nth): (r.head, r.copies) for r in got}


@pytest.mark.parametrize("size", [1, 40, 10**6])
def test_shared_values_are_those_of_brute_force(spark, size):
    """One value in a third of all documents, documents that repeat values, NULL doc_ids, documents without values."""
    rng = random.Random(size)
    rows = []
    for key in range(60):
        values = [rng.choice((rng.randrange(-40, 40), rng.randrange(-(2**63), 2**63))) for _ in range(rng.randrange(12))]
        if key % 3 == 0:
            values += [7] * rng.randrange(1, 5)
        rows.append((rng.randrange(-(2**62), 2**62), None if key % 10 == 9 else f"d{rng.randrange(30):02}", values))
    times, holders = Counter(), defaultdict(set)
    for key, doc, values in rows:
        for v in values:
            times[v] += 1
            holders[v].add((doc is None, doc or "", key))
    expected = {(key, i): (min(holders[v])[2], times[v]) for key, _, values in rows for i, v in enumerate(values) if len(holders[v]) > 1}
    assert shared(spark, rows, size) == expected and expected


def test_arrays_come_back():
    arrays = [np.arange(5, dtype=np.uint32), np.zeros(0, np.int64), np.array([-1, 2**62]), np.array([0, 255], np.uint8)]
    back = P.unpack(P.pack(*arrays))
    assert all(a.dtype == b.dtype and a.tolist() == b.tolist() for a, b in zip(arrays, back, strict=True))
