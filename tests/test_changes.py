"""Change logs against a plain replay."""

import random

import pytest

from loomtext.operators import changes
from loomtext.operators.changes import ChangeLog


def replay(rows):
    docs, shared = {}, {}
    for seq, kind, doc, by, user, title, content in sorted(rows):
        if kind == "create":
            if doc not in docs:
                docs[doc], shared[doc] = [title, by, content, "0"], set()
            continue
        if doc not in docs or docs[doc][3] == "1":
            continue
        mine = docs[doc][1] == by
        if kind == "delete":
            if mine:
                docs[doc][3] = "1"
            else:
                shared[doc].discard(by)
        elif mine and kind == "rename":
            docs[doc][0] = title or docs[doc][0]
            shared[doc].clear()
        elif mine and kind == "share":
            shared[doc].add(user)
        elif mine:
            shared[doc].discard(user)
    return {(d, *v) for d, v in docs.items()}, {(d, u) for d, us in shared.items() for u in us}


def made(seed, low, high, docs=12):
    rng = random.Random(seed)
    out = []
    for seq in range(low, high):
        doc, kind = rng.randrange(docs), rng.choices(changes.KINDS, weights=[3, 2, 8, 2, 1])[0]
        out.append((seq, kind, doc, rng.choice([doc % 3, doc % 3, 3, 4]), rng.choice([3, 4, 5]) if "share" in kind else None, rng.choice(["", None, f"t{seq}"]) if kind in ("create", "rename") else None, f"c{seq}" if kind == "create" else None))
    return out


def state(log):
    return {(r["doc_id"], r["title"], r["creator"], r["content"], r["is_delete"]) for r in log.documents().collect()}, {(r["doc_id"], r["user_id"]) for r in log.shares().collect()}


@pytest.mark.parametrize("seed", (1, 2, 3))
def test_state_equals_a_replay(spark, tmp_path, seed):
    frame = lambda rows: spark.createDataFrame(rows, changes.COLUMNS)
    rows = [*made(seed, 0, 60), *made(seed + 10, 60, 90), *made(seed + 20, 90, 160)]
    log = ChangeLog.open(spark, f"file://{tmp_path}/log").append(frame(rows[:60])).append(frame(rows[60:90]))
    assert state(log) == replay(rows[:90])
    small = log.compact()
    assert state(small) == replay(rows[:90]) and small.rows().count() <= log.rows().count() and len(small.manifest["batches"]) == 1
    with pytest.raises(RuntimeError, match="by another"):
        log.append(frame(rows[90:]))
    with pytest.raises(ValueError, match="not after"):
        small.append(frame(rows[88:]))
    grown = ChangeLog.open(spark, small.path).append(frame(rows[90:]))
    assert state(grown) == replay(rows) == state(grown.compact())


def test_empty_and_odd_logs(spark, tmp_path):
    log = ChangeLog.open(spark, f"file://{tmp_path}/none")
    assert state(log) == (set(), set())
    with pytest.raises(ValueError, match="no kind"):
        log.append(spark.createDataFrame([(1, "other", 1, 1, None, None, None)], changes.COLUMNS))
    assert log.append(spark.createDataFrame([(1, "create", 1, 1)], "seq long, kind string, doc_id long, by long")).documents().count() == 1
    notices = spark.createDataFrame([(1,), (2,)], "doc_id long")
    docs = spark.createDataFrame([(1, "1"), (2, "0")], "doc_id long, is_delete string")
    assert [r["doc_id"] for r in changes.notices_left(notices, docs).collect()] == [2]
