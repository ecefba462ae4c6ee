import random

from hypothesis import given, settings
from hypothesis import strategies as st

from ridgeline.llm import packing, tokens

from .conftest import DATA


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_every_piece_has_its_place(lengths):
    bins, offsets, sizes = packing.pack(lengths, (8, 16, 64))
    filled = {}
    for n, b, o in zip(lengths, bins, offsets, strict=True):
        filled.setdefault(b, []).append((o, n))
    assert len(filled) == len(sizes)
    for b, parts in filled.items():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= sizes[b] and sizes[b] == min(c for c in (8, 16, 64) if c >= end)


def test_fills_well():
    rng = random.Random(1)
    lengths = [min(8192, int(rng.lognormvariate(6, 1)) + 1) for _ in range(4000)]
    bins, _, sizes = packing.pack(lengths)
    assert sum(lengths) / sum(sizes) > 0.99


def test_cost_chooses_the_size():
    assert packing.pack([300, 200])[2] == [512]
    assert len(packing.pack([500] * 16, (512, 8192), lambda c: 1.0)[2]) == 1
    assert len(packing.pack([512] * 16, (512, 8192), lambda c: float(c) ** 2)[2]) == 16


def test_long_documents_are_cut_and_kept_whole(spark, edge, none):
    df = spark.createDataFrame([(1, 40_000), (2, None), (3, 0), (3, 0)], "id long, tokens long")
    rows = packing.packed(df).collect()
    one = sorted((r.start, r.length) for r in rows if r.id == 1)
    assert sum(n for _, n in one) == 40_001 and [s for s, _ in one] == [i * 8192 for i in range(5)]
    assert sorted(r.length for r in rows if r.id != 1) == [1, 1, 1]
    sized = lambda d: packing.packed(d.select(d.doc_id.alias("id"), packing.byte_tokens().alias("tokens")))
    assert sized(edge).groupBy("id").sum("length").count() == edge.count() and sized(none).count() == 0


def test_groups_do_not_share_bins(spark):
    df = spark.range(3000).selectExpr("id", "id % 700 AS tokens")
    rows = packing.packed(df, group=500).collect()
    used = {}
    for r in rows:
        used.setdefault((r.bin_id, r.capacity), []).append((r.bin_offset, r.length))
    assert len({b for b, _ in used}) == len(used)
    for (_, capacity), parts in used.items():
        assert sum(n for _, n in parts) <= capacity and len({o for o, _ in parts}) == len(parts)


def test_query_packs_exact_token_counts(spark, docs):
    count = tokens.counter(tokens.tokenizer_path("byte_bpe_50k.json"))
    want = {r.doc_id: tokens.total(count.changes(r.text or "")) + 1 for r in docs.collect()}
    got, filled = {}, {}
    for r in packing.op5_packing(spark, DATA).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        filled[r.bin_id, r.capacity] = filled.get((r.bin_id, r.capacity), 0) + r.length
    assert got == want and all(n <= capacity for (_, capacity), n in filled.items())


def plain_best_fit(lengths, sizes, cost):
    """The rule, bin by bin: of the open bins with least room the last changed; else the size that costs least a token."""
    bins, where = [], [None] * len(lengths)  # bin: [room, last change, used]
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    for turn, i in enumerate(order):
        n, waiting = lengths[i], sorted((lengths[j] for j in order[turn + 1 :]), reverse=True)
        fits = [b for b in bins if b[0] >= n]
        if fits:
            chosen = min(fits, key=lambda b: (b[0], -b[1]))
        else:
            def tokens(room):
                got = 0
                for w in waiting:
                    if w <= room:
                        room, got = room - w, got + w
                return got
            size = min((c for c in sizes if c >= n), key=lambda c: (cost(c) / (n + tokens(c - n)), c))
            chosen = [size, 0, 0]
            bins.append(chosen)
        where[i] = (bins.index(chosen) if not fits else next(k for k, b in enumerate(bins) if b is chosen), chosen[2])
        chosen[:] = [chosen[0] - n, turn + 1, chosen[2] + n]
    return [w[0] for w in where], [w[1] for w in where], [min(c for c in sizes if c >= b[2]) for b in bins]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=40))
def test_equals_plain_best_fit(lengths):
    sizes = (8, 16, 64)
    bins, offsets, opened = packing.pack(lengths, sizes)
    assert (list(bins), list(offsets), list(opened)) == plain_best_fit(lengths, sizes, packing.place_cost)


def test_query_equals_plain_best_fit(spark):
    """The query's rows, group by group, against the plain rule over its own pieces."""
    rows = packing.op5_packing(spark, DATA).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.bin_id >> 32, []).append(r)
    for group in groups.values():
        group.sort(key=lambda r: (r.doc_id, r.piece))
        bins, offsets, sizes = plain_best_fit([r.length for r in group], packing.CAPACITIES, packing.place_cost)
        assert [(r.bin_id & 0xFFFFFFFF, r.bin_offset, r.capacity) for r in group] == [(b, o, sizes[b]) for b, o in zip(bins, offsets, strict=True)]


def test_groups_are_bounded_by_pieces(spark):
    rows = spark.createDataFrame([(i, 1_000_000) for i in range(10)], "id long, tokens long")
    many = packing.packed(rows, group=128).groupBy((packing.F.col("bin_id") / (1 << 32)).cast("long")).count().collect()
    assert len(many) > 6 and max(r["count"] for r in many) < 256
