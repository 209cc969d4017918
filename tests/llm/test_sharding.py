import zlib
from itertools import pairwise

from helpers import EDGE, frame

from gridloom.llm import sharding


def test_law_slots_sizes_and_checksums(spark):
    docs = frame(spark, EDGE, extra=True)
    got = sharding.shard(docs, 4).collect()
    assert len(got) == len(EDGE)
    counts = [sum(r.shard == s for r in got) for s in range(4)]
    assert max(counts) - min(counts) <= 1
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    want = sorted(str((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))) for d, t, *_ in EDGE)
    assert sorted(str((r.doc_id, r.size, r.text_crc32)) for r in got) == want
    ranked = [r.cell for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert ranked == sorted(ranked)
    assert sharding.shard(docs.limit(0)).count() == 0


def test_more_shards_than_rows(spark):
    got = sharding.shard(frame(spark, [(1, "a"), (2, "b"), (3, "c")]), 16).collect()
    assert [r.slot for r in got] == [0, 0, 0] and len({r.shard for r in got}) == 3


def test_curve_visits_each_cell_once_by_unit_steps(spark):
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        names = tuple(f"d{i}" for i in range(dims))
        n = 1 << bits
        cells = spark.range(n**dims).selectExpr(*[f"cast(id div {n**i} % {n} as bigint) as d{i}" for i in range(dims)])
        rows = sorted(sharding.hilbert_index(cells, names, bits, "h").collect(), key=lambda r: r.h)
        assert [r.h for r in rows] == list(range(n**dims))
        assert all(sum(abs(a[c] - b[c]) for c in names) == 1 for a, b in pairwise(rows))


def test_real_table_prunes(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sharding.shard(docs).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in docs.select("doc_id").collect())


def brute(spark, rows, shards):
    """doc_id, checksum -> (shard, slot), by sorting all rows in Python."""
    import hashlib

    bits, top = sharding.BITS, (1 << sharding.BITS) - 1
    cells = spark.range(1 << 4 * bits).selectExpr(*[f"id div {1 << bits * i} % {1 << bits} as {d}" for i, d in enumerate(sharding.DIMS)])
    curve = {tuple(r[d] for d in sharding.DIMS): r.cell for r in sharding.hilbert_index(cells, sharding.DIMS, bits, "cell").collect()}
    ids = [r[0] for r in rows if r[0] is not None]
    lo, hi = (min(ids), max(ids)) if ids else (0, 0)
    digit = lambda x: 0 if x is None else int(hashlib.md5(x.encode()).hexdigest()[:4], 16) % (top + 1)
    order = []
    for i, t, lang, source in rows:
        raw = (t or "").encode()
        size, crc = len(raw) + 1, zlib.crc32(raw)
        q_id = 0 if i is None else (i - lo) * (top + 1) // (hi - lo + 1)
        cell = curve[digit(source), digit(lang), q_id, min(max(size.bit_length() - 5, 0), top)]
        order.append((cell, i is not None, i or 0, crc, size))
    order.sort()
    n, out = len(order), []
    for k, (cell, some, i, crc, size) in enumerate(order):
        s = k * shards // n
        out.append((i if some else None, size, crc, s, k - -(-s * n // shards), cell))
    return sorted(map(str, out))


def test_order_matches_brute_force(spark, sf, monkeypatch):
    rows = [(r[0], r[1], *(r[2:] if len(r) > 2 else ("en", "s"))) for r in EDGE]
    rows += [(None, f"text {k}", None if k % 3 else "de", "hot") for k in range(40)] + [(-(2**62), "far", "en", None)]
    rows += [(k, f"row {k % 7} " * (k % 50), ["en", "de", None][k % 3], ["hot", "s", None, "t"][k % 4]) for k in range(100, 700)]
    real = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    for table, most in ((rows, sharding.BROADCAST_RANGES), (rows, 0), (real, 0)):
        monkeypatch.setattr(sharding, "BROADCAST_RANGES", most)
        got = sharding.shard(frame(spark, table), 16).collect()
        assert sorted(str((r.doc_id, r.size, r.text_crc32, r.shard, r.slot, r.cell)) for r in got) == brute(spark, table, 16)


def test_a_filter_on_several_dimensions_reads_few_files(spark, tmp_path):
    # what the order is for: files in curve order, and how many of them a filter must open by their statistics
    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    key = ["doc_id", "size", "text_crc32"]
    rows = docs.withColumn("size", (F.octet_length("text") + 1).cast("long")).withColumn("text_crc32", F.crc32(F.col("text").cast("binary")))
    rows = rows.join(sharding.shard(docs).select(*key, "shard", "slot"), key)
    rows.repartition(16, "shard").sortWithinPartitions("slot").write.partitionBy("shard").parquet(f"{tmp_path}/curve")
    rows.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(16))).write.partitionBy("shard").parquet(f"{tmp_path}/hash")

    def opened(kind, lang, source, most):
        n = 0
        for f in (tmp_path / kind).glob("shard=*/*.parquet"):
            m = pq.read_metadata(f)
            at = {m.schema.column(c).name: c for c in range(m.num_columns)}
            stats = [{c: m.row_group(g).column(at[c]).statistics for c in ("lang", "source", "size")} for g in range(m.num_row_groups)]
            n += any(s["lang"].min <= lang <= s["lang"].max and s["source"].min <= source <= s["source"].max and s["size"].min <= most for s in stats)
        return n

    pairs = [(r.lang, r.source) for r in docs.select("lang", "source").distinct().collect()][:12]
    curve, hashed = (sum(opened(k, *p, 300) for p in pairs) for k in ("curve", "hash"))
    assert curve < 0.85 * hashed, (curve, hashed)
