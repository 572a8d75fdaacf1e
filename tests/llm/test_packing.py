import random

from talus.llm.packing import CAPACITIES, pack, pack_group


def check(rows, items):
    bins = {}
    for r in rows:
        bins.setdefault(r.bin_id, []).append(r)
    for got in bins.values():
        got.sort(key=lambda r: r.offset)
        used = 0
        for r in got:
            assert r.offset == used
            used += r.length
        assert got[0].capacity == min(c for c in CAPACITIES if c >= used)
    have = {}
    for r in rows:
        have[r.doc_id] = have.get(r.doc_id, 0) + r.length
    want = {}
    for i, n in items:
        want[i] = want.get(i, 0) + max(n or 1, 1)
    assert have == want


def test_bins_hold_everything_once(spark):
    rng = random.Random(3)
    items = [(i, rng.choice([1, 7, 300, 512, 900, 4096, 4097, 20000])) for i in range(400)]
    items += [(500, None), (501, 0), (7, 30), (7, 30)]
    df = spark.createDataFrame(items, "doc_id long, length int").withColumn("bin_id", __import__("pyspark").sql.functions.lit("x"))
    rows = pack(df, group_rows=100).collect()
    check(rows, items)
    bins = {r.bin_id: r.capacity for r in rows}
    assert sum(r.length for r in rows) / sum(bins.values()) > 0.9


def best_fit(lengths, capacities, attention, floor):
    """Best-fit decreasing by trying every bin; bins are opened at the cheapest capacity from ``floor`` up."""
    cost = lambda c: c * (1 + c * attention)
    bins = []
    for n in lengths:
        fits = [b for b in bins if b[0] - sum(b[1]) >= n]
        if fits:
            min(fits, key=lambda b: b[0] - sum(b[1]))[1].append(n)
        else:
            bins.append((min((c for c in capacities if c >= max(n, floor)), key=cost), [n]))
    return sum(cost(min(c for c in capacities if c >= sum(b[1]))) for b in bins)


def test_against_trying_every_bin():
    rng = random.Random(11)
    for _ in range(40):
        lengths = sorted((rng.randint(1, 64) for _ in range(rng.randint(1, 60))), reverse=True)
        caps, attention = (16, 32, 64), rng.choice([0.0, 0.01])
        bins, sizes = pack_group(lengths, caps, attention)
        got = sum(c * (1 + c * attention) for c in sizes)
        assert abs(got - min(best_fit(lengths, caps, attention, f) for f in caps)) < 1e-9


def test_repeated_and_long_rows_are_spread(spark):
    rows = spark.createDataFrame([(4, 300)] * 1000 + [(None, 5_000_000), (2**53 + 1, 7)], "doc_id long, length long")
    got = pack(rows, group_rows=100).collect()
    sizes = {}
    for r in got:
        sizes[r.bin_id >> 32] = sizes.get(r.bin_id >> 32, 0) + 1
    assert len(sizes) > 15 and max(sizes.values()) < 180
    assert sum(r.length for r in got if r.doc_id == 4) == 300_000
    assert sum(r.length for r in got if r.doc_id is None) == 5_000_000
    assert [r.length for r in got if r.doc_id == 2**53 + 1] == [7]


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, length int")).collect() == []


def test_joint_sizes_cost_no_more_than_any_single_opening_size():
    rng = random.Random(5)
    lengths = sorted((rng.randint(1, 700) for _ in range(300)), reverse=True)
    bins, sizes = pack_group(lengths, (256, 512, 1024), 0.0)
    only, one = pack_group(lengths, (1024,), 0.0)
    assert sum(sizes) <= sum(one)
    assert len(bins) == len(lengths)
