"""op10 on small Parquet tables, with rows in any order."""

import random
import zlib

import pytest

from tempora.llm import sharding


def check_shards(got, rows, shards=24):
    """Sizes, sums and slots as they must be; groups of equal texts whole unless larger than the mean shard. Returns the shards' bytes."""
    data = [(t or "").encode() for _, t in rows]
    mean = sum(len(x) + 8 for x in data) / shards
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(i), len(x) + 8, zlib.crc32(x)) for (i, _), x in zip(rows, data, strict=True))
    slots, where, group, total = {}, {}, {}, [0] * shards
    for r in got:
        assert r["law"] == "bytes" and r["grown_shard"] is None
        slots.setdefault(r["shard"], []).append(r["slot"])
        where.setdefault(r["text_crc32"], set()).add(r["shard"])
        group[r["text_crc32"]] = group.get(r["text_crc32"], 0) + r["size"]
        total[r["shard"]] += r["size"]
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    for g, n in group.items():
        assert len(where[g]) <= -(-n // mean) + (n > mean)
    return total, mean


@pytest.mark.parametrize("big", [0, 400, 20_000])
def test_op10_keeps_groups_whole(spark, tables, big):
    r = random.Random(10)
    rows = [(k, "x" * r.randrange(400) + str(k)) for k in range(4000)]
    for g in range(60):
        rows += [(10_000 + 100 * g + j, f"copies of {g} " * 5) for j in range(r.choice([2, 3, 20, 90]))]
    rows += [(100_000 + k, "the largest group " * 4) for k in range(big)]
    rows += [(None, None), (None, "no id"), (None, None), (7, None), (7, ""), (8, "twin"), (8, "twin"), (9, "long " * 1000)]
    total, mean = check_shards(sharding.op10_sharding(spark, tables("documents", rows, "doc_id long, text string")).collect(), rows)
    assert max(abs(x - mean) for x in total) <= 0.03 * mean
    assert sharding.op10_sharding(spark, tables("documents", [], "doc_id long, text string")).count() == 0


def test_op10_on_the_tables(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = sharding.op10_sharding(spark, d).collect()
    total, mean = check_shards(got, rows)
    assert max(abs(x - mean) for x in total) <= 0.05 * mean
    assert sorted(map(str, sharding.op10_sharding(spark, d).collect())) == sorted(map(str, got))


def test_op10_evens_out_around_a_huge_row(spark, tables):
    rows = [(k, f"text {k}") for k in range(3000)] + [(9000, "huge " * 4000)]
    total, _ = check_shards(sharding.op10_sharding(spark, tables("documents", rows, "doc_id long, text string")).collect(), rows)
    assert sorted(total)[-1] == 20_008 and sorted(total)[-2] - min(total) <= 0.03 * min(total)
