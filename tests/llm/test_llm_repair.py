import hashlib
import heapq
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from riskmart.llm import repair

ROLES = st.sampled_from(["user", "assistant", "system", "tool", ""])
TEXTS = st.sampled_from(["Hi.", "Ok!", "cut", "", " \n", "So?", "Yes."])


def by_search(rows):
    """The cheapest edits by trying all, cheapest and ASCII-least first; rows are (role, text, removed, truncated)."""
    heap = [(0, "", 0, "", ())]
    while True:
        cost, audit, i, roles, out = heapq.heappop(heap)
        want = {"": "user", "s": "user", "u": "assistant", "a": "user"}[roles[-1:]]
        if i == len(rows) and roles[-1:] in ("", "a"):
            return cost, audit, out
        if len(audit) < 3 * len(rows) + 3:
            heapq.heappush(heap, (cost + 5, audit + "I", i, roles + want[0], (*out, f"{want}:")))
        if i < len(rows):
            role, text, removed, truncated = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, roles, out))
            if not removed:
                more = 5 if truncated else 0
                heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, roles + want[0], (*out, f"{want}:{text}")))
                if role[:1] == want[0] or role[:1] == "s" and not roles:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, roles + role[:1], (*out, f"{role}:{text}")))


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.rstrip(repair.SPACES)
        kind = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(kind)
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(ROLES, TEXTS), max_size=6))
@pytest.mark.parametrize(("every", "base"), [(1, repair.BASE), (256, repair.BASE), (1, 0), (256, 0)])
def test_edits_are_the_cheapest(every, base, rows):
    """Also where rows settle at once, and where all hashes of equal last edits collide."""
    kinds = faults(rows)
    given_rows = [(r, t, k in ("blank", "duplicate"), k == "truncated") for (r, t), k in zip(rows, kinds, strict=True)]
    audit, out = [], []

    def emit(edit, role, text):
        audit.append(edit)
        if role is not None:
            out.append(f"{role}:{text}")

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(repair, "SETTLE_ROWS", every)
        patch.setattr(repair, "BASE", base)
        one = repair.Repair(emit)
        for row in given_rows:
            one.row(*row)
        cost = one.finish()
    assert (cost, "".join(audit), tuple(out)) == by_search(given_rows)


def test_long_conversations_are_not_held():
    held, count = [], 0

    def emit(edit, role, text):
        nonlocal count
        count += 1

    one = repair.Repair(emit)
    for i in range(20_000):
        one.row("user" if i % 2 == 0 else "assistant", f"turn {i}.", False, i % 7 == 0)
        held.append(len(one.rows))
    one.finish()
    assert count >= 20_000 and max(held) < 3 * repair.SETTLE_ROWS


def expected(rows):
    """op11 by plain Python."""
    by, out = defaultdict(list), {}
    for conv, turn, role, text in rows:
        by[conv]
        role, text = role if role is not None else " ", text if text is not None else " "
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(name.encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else text.translate({ord(c): None for c in ".!?"}) if fault == 2 else text
        by[conv] += [(turn is not None, turn or 0, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    for conv, kept in by.items():
        kept.sort()
        kinds = faults([r[2:] for r in kept])
        cost, audit, lines = by_search([(r, t, k in ("blank", "duplicate"), k == "truncated") for (*_, r, t), k in zip(kept, kinds, strict=True)])
        turns = {t for known, t, *_ in kept if known}
        initials = [r[:1] for *_, r, _ in kept]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        counts = [kinds.count(k) for k in ("blank", "duplicate", "truncated")]
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


SCHEMA = "conv_id long, turn long, role string, text string, copies string, early int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def test_damaged_and_audited(spark):
    words = ["Fine.", "Go on", "Why?", " ", "", None, "Yes! ", "same.", "same."]
    rows = [(c, t, ("user", "assistant", "system", None, "tool")[(c * 7 + t * t) % 5 if c % 3 else t % 2], words[(c + 3 * t) % 9]) for c in range(60) for t in range(c % 6)]
    rows += [(100, None, "user", "Hi."), (100, None, "user", "Hi."), (100, 3, "user", "Hi."), (100, 3, "assistant", "Hi."), (100, 9, "assistant", "Hi.")]
    rows += [(None, 1, "user", "a."), (None, 2, "assistant", "b."), (101, None, None, None), (102, -(1 << 63), "user", "x."), (102, (1 << 63) - 1, "assistant", "y.")]
    lost = next(i for i in range(1000) if zlib.crc32(f"{200 + i}:0".encode()) % 20 == 0)
    rows += [(200 + lost, 0, "user", "gone.")]
    got = {r.conv_id: tuple(r)[1:] for r in repair.audited(repair.damaged(frame(spark, rows))).collect()}
    want = expected(rows)
    want[102] = (min(want[102][0], (1 << 63) - 1), *want[102][1:])
    assert got == want
    assert got[200 + lost] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "And?"), (1, 2, "assistant", "Yes."), (2, 0, "assistant", " "), (3, 0, "user", "A."), (3, 1, "assistant", "B.")]
    plain = spark.createDataFrame(rows, "conv_id int, turn long, role string, text string")
    got = sorted(map(tuple, repair.repaired(plain).collect()))
    assert [r[:4] for r in got if r[0] == 3] == [r for r in rows if r[0] == 3]
    assert not [r for r in got if r[0] == 2]
    digests = {r.conv_id: r.repaired_sha256 for r in repair.audited(plain).collect()}
    for conv in (1, 2, 3):
        lines = [f"{role}:{text}" for c, _, role, text, _ in got if c == conv]
        assert digests[conv] == hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_no_conversations(spark):
    empty = frame(spark, [])
    assert repair.audited(repair.damaged(empty)).count() == 0
    assert repair.repaired(empty.drop("copies")).count() == 0
