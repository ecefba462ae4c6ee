import numpy as np
import pyarrow as pa

from ridgeline.llm import blocks, exchange


def test_packets_are_proportional_to_the_corpus():
    """Partitions keep their size, and a packet of an exchange holds the same share of a block, from 1 GB to 100 TB."""
    part = 16 << 20
    assert blocks.parts_for(0, part) == 2
    for size in (10**9, 10**12, 10**14):
        parts = blocks.parts_for(size, part)
        assert abs(parts * part / size - 1) < 0.05
        bits = exchange.levels(parts)
        assert max(bits) <= exchange.BITS and parts <= 1 << sum(bits) < 2 * parts and len(bits) <= 4


def test_sorted_keys_are_packed_near_their_entropy():
    """Also where the first key of a packet needs more than four bytes; a step of 2 ** k on average takes about k + 1.5 bits."""
    rng = np.random.default_rng(1)
    for n, bits in ((0, 1), (1, 64), (3, 64), (9000, 36), (9000, 29), (300, 64)):
        x = np.unique(rng.integers(0, 1 << bits, n, dtype=np.uint64)) if bits < 64 else np.sort(rng.integers(0, 2**64 - 1, n, dtype=np.uint64, endpoint=True))
        for keys in (x, x + np.uint64(5 << 36) if bits < 64 else x):
            blob = exchange.pack_sorted(keys)
            assert (exchange.unpack_sorted(blob) == keys).all()
            assert n < 9000 or len(blob) < n * (bits - np.log2(n) + 1.5 + 2.5) / 8
    assert (exchange.unpack_sorted(exchange.pack_sorted(np.array([0, 0, 7, 2**64 - 1], np.uint64))) == [0, 0, 7, 2**64 - 1]).all()


def test_slices_hold_every_row_once():
    batch = pa.RecordBatch.from_pydict({"x": ["a" * n for n in range(500)]})
    got = [x for part in blocks.slices(batch, 2000) for x in part.column(0).to_pylist()]
    assert got == batch.column(0).to_pylist() and len(list(blocks.slices(batch, 2000))) > 10
    assert list(blocks.slices(batch.slice(0, 0))) == []


def test_claims_clear_other_caches():
    held = {"a": 1}
    blocks.claim("one", held.clear)
    blocks.claim("one", held.clear)
    assert held
    blocks.claim("two", lambda: None)
    assert not held


def test_kept_tables_lie_in_the_shared_folder(spark):
    df = spark.range(5)
    table = blocks.kept(df, "five")
    assert table.count() == 5 and table.dtypes == df.dtypes
    assert all(f.startswith(blocks.shared_folder(spark).replace("file:///", "file:/")[:12]) for f in [x.replace("file:///", "file:/") for x in table.inputFiles()])
    files = table.inputFiles()
    blocks.drop(table)
    import os

    assert not any(os.path.exists(f.removeprefix("file://")) for f in files)
