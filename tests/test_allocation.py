"""Quotas and the choice of arrivals against plain loops over random channels."""

import random

import pytest

from lorewell.operators import ledger


def plain_quotas(counts, total):
    """counts: {channel: (n, room)}."""
    open_ = {c: min(v) for c, v in counts.items() if min(v) > 0}
    if total <= 0 or not open_:
        return {}
    weight = sum(counts[c][0] ** 0.5 for c in open_)
    got = {c: min(top, int(total * counts[c][0] ** 0.5 / weight)) for c, top in open_.items()}
    largest = sorted(open_, key=lambda c: (-counts[c][0], c))
    for c in largest:
        if got[c] == 0 and sum(got.values()) < total:
            got[c] = 1
    for c in largest:
        while got[c] < open_[c] and sum(got.values()) < total:
            got[c] += 1
    return {c: q for c, q in got.items() if q}


@pytest.mark.parametrize("total", [0, 1, 3, 7, 20, 45, 400])
def test_quotas_fill_the_total(spark, total):
    draw = random.Random(total)
    counts = {f"c{i}": (draw.choice([0, 1, 1, 2, 5, 5, 40, 900]), draw.randrange(8)) for i in range(14)}
    rows = spark.createDataFrame([(c, n, room, total) for c, (n, room) in counts.items()], "channel string, n long, room int, total int")
    got = {r.channel: r.quota for r in ledger.quotas(rows).collect()}
    assert got == plain_quotas(counts, total) and sum(got.values()) == min(total, sum(max(0, min(v)) for v in counts.values()))


def plain_choice(rows, size, cap, most):
    tiers = {}
    for r in rows:
        if r["salience"] is not None:
            tiers.setdefault((r["salience"], r["novelty"] or 0), {}).setdefault(r["channel"], []).append(r)
    ranked = []
    for key in sorted(tiers, reverse=True):
        queues = [sorted(q, key=lambda r: (r["created_at"], r["id"]), reverse=True) for _, q in sorted(tiers[key].items(), key=lambda kv: (-len(kv[1]), kv[0]))]
        ranked += [q[i] for i in range(max(map(len, queues))) for q in queues if i < len(q)]
    chosen = []
    for r in ranked:
        full = sum(c["channel"] == r["channel"] for c in chosen) >= cap or (r["generated"] and sum(c["generated"] for c in chosen) >= most)
        if len(chosen) < size // 2 and not full:
            chosen.append(r)
    out = {(r["id"], "salience") for r in chosen}
    ids = {r["id"] for r in chosen}
    for generated in (False, True):
        left = [r for r in rows if r["id"] not in ids and r["generated"] == generated]
        counts = {c: (sum(r["channel"] == c for r in left), cap - sum(r["channel"] == c for r in chosen)) for c in {r["channel"] for r in left}}
        room = size - len(out) if not generated else min(most - sum(r["generated"] for r in chosen), size - len(out))
        for c, q in plain_quotas(counts, room).items():
            out |= {(r["id"], "share") for r in sorted((r for r in left if r["channel"] == c), key=lambda r: (-r["created_at"], r["id"]))[:q]}
    return out


@pytest.mark.parametrize("size, cap, most", [(14, 4, 3), (40, 3, 2), (5, 4, 0), (30, 40, 30), (2, 1, 1)])
def test_choice_of_arrivals(spark, size, cap, most):
    draw = random.Random(size)
    rows = []
    for i in range(160):
        generated = draw.random() < 0.2
        channel = f"generated:{draw.randrange(2)}" if generated else draw.choice(["a", "a", "a", "a", "b", "c", "d", ""])
        rows.append({"id": i, "channel": channel, "generated": generated, "salience": draw.choice([None, 0, 1, 2, 3]), "novelty": draw.choice([None, 0, 1]), "created_at": draw.randrange(40)})
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "id long, channel string, generated boolean, salience int, novelty int, created_at long")
    assert {(r.id, r.why) for r in ledger.select_arrivals(df, size, cap, most).collect()} == plain_choice(rows, size, cap, most)


def test_no_arrivals(spark):
    df = spark.createDataFrame([], "id long, channel string, generated boolean, salience int, novelty int, created_at long")
    assert ledger.select_arrivals(df).collect() == []
