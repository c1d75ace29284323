import random
import zlib
from collections import Counter, defaultdict

import pytest

from guestlens.llm.sharding import Cell, group_fetcher, minimax_cuts, shard_documents

SCHEMA = "doc_id long, text string, size string"


def brute_cuts(groups, shards):
    """Least capacity over (code, size) in order, by trying every sum of neighbours' worth of capacity."""
    def needs(capacity):
        count, held = 1, 0
        for _, size in groups:
            if size > capacity:
                return shards + 1
            if held + size > capacity:
                count, held = count + 1, 0
            held += size
        return count

    low, high = 0, sum(s for _, s in groups)
    while low < high:
        mid = (low + high) // 2
        if needs(mid) <= shards:
            high = mid
        else:
            low = mid + 1
    return low


def loads(groups, cuts, shards):
    out = [0] * shards
    for code, size in groups:
        out[sum(code > c for c in cuts)] += size
    return out


@pytest.mark.parametrize("cells", [4, 16, 256])
def test_cuts_equal_those_of_a_search_over_all_groups(cells):
    rng = random.Random(cells)
    for trial in range(40):
        spread = rng.choice([10, 2**20, 2**62])
        groups = sorted({rng.randint(-spread, spread): rng.choice([1, 5, 17, 400]) for _ in range(rng.randint(0, 60))}.items())
        shards = rng.randint(1, 9)

        def fetch(ranges, bits):
            found = defaultdict(list)
            for code, size in groups:
                if any(a <= code <= b for a, b in ranges):
                    found[code >> bits].append((code, size))
            return [Cell(v[0][0], v[-1][0], sum(s for _, s in v)) for _, v in sorted(found.items())]

        cuts = minimax_cuts(fetch, shards, cells)
        assert max(loads(groups, cuts, shards), default=0) == brute_cuts(groups, shards), (groups, shards)


def test_documents(spark):
    rng = random.Random(3)
    texts = [None, "", *("word " * rng.randint(1, 40) + str(i) for i in range(400))]
    rows = [(i if i % 50 else None, rng.choice(texts), "clash") for i in range(900)] + [(5000 + i, "copied text", "clash") for i in range(300)]
    rows += [rows[0], rows[0]]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = shard_documents(docs, shards=12, rows_per_bucket=37, cells=64).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    by_text, by_shard, load = defaultdict(set), defaultdict(list), Counter()
    for r in got:
        by_text[r.text_crc32, r["size"]].add(r.shard)
        by_shard[r.shard].append(r.slot)
        load[r.shard] += r["size"]
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 12
    assert all(len(v) == 1 for v in by_text.values())
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    assert Counter((r.text_crc32, r["size"]) for r in got) == Counter(
        (zlib.crc32((t or "").encode()), len((t or "").encode()) + 16) for _, t, _ in rows
    )
    share = sum(load.values()) / 12
    largest = Counter()
    for _, t, _ in rows:
        largest[t] += len((t or "").encode()) + 16
    assert max(load.values()) <= max(share + max(s for s in largest.values() if s < share), max(largest.values()))
    assert len(load) == 12


def test_small_inputs(spark):
    assert shard_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    one = shard_documents(spark.createDataFrame([(1, "a", "")], SCHEMA)).collect()
    assert [(r["size"], r.slot, r.text_crc32) for r in one] == [(17, 0, zlib.crc32(b"a"))]
    same = shard_documents(spark.createDataFrame([(i, "a", "") for i in range(9)], SCHEMA)).collect()
    assert len({r.shard for r in same}) == 1 and sorted(r.slot for r in same) == list(range(9))
    few = shard_documents(spark.createDataFrame([(i, str(i), "") for i in range(40)], SCHEMA)).collect()
    assert len({r.shard for r in few}) >= 38


def test_many_groups_and_ranges(spark):
    """60,000 groups, and ranges by the thousand in one call."""
    from pyspark.sql import functions as F

    groups = spark.range(60_000).select(F.xxhash64("id").alias("code"), (F.col("id") % 97 + 1).alias("bytes")).cache()
    plain = sorted((r.code, r["bytes"]) for r in groups.collect())
    for cells in (256, 1 << 16):
        cuts = minimax_cuts(group_fetcher(groups), 40, cells)
        assert max(loads(plain, cuts, 40)) == brute_cuts(plain, 40)
    fetch = group_fetcher(groups)
    fetch([(-(2**63), 2**63 - 1)], 50)
    ranges = [(c << 50, (c + 1 << 50) - 1) for c in range(-8192, 8192, 3)]
    assert len(ranges) > 5000
    found = fetch(ranges, 40)
    assert sum(c.size for c in found) == sum(size for code, size in plain if (code >> 50) % 3 == -8192 % 3)


def test_repeated_rows_are_numbered_in_many_buckets(spark):
    docs = spark.range(0, 4000, 1, 8).selectExpr("7L AS doc_id", "'same' AS text")
    got = shard_documents(docs, shards=4, rows_per_bucket=100).collect()
    assert sorted(r.slot for r in got) == list(range(4000)) and len({r.shard for r in got}) == 1
