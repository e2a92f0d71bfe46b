"""The search layout: what is found, what is read, and what patterns begin with."""

import random
import re

import pytest

from flowwatch.operators import layout as LY
from flowwatch.operators import search as SE
from rows import packet, table


@pytest.mark.parametrize("pattern, want", [
    (r"^10\.0\.[0-1]\.", ["10.0.0.", "10.0.1."]), (r"^10\.0*", ["10."]), ("^10?", ["1"]), ("^12+", ["12"]), ("10", []), ("^", []),
    ("^a|^b", []), ("^(?i)a", []), (r"^1\d", ["1"]), ("^1.2", ["1"]), ("^fe80:[ab]", ["fe80:a", "fe80:b"]), ("^1{2}", []),
    ("^[0-9][0-9]", [str(k) for k in range(10)]), ("^[^1]", []), ("^[3-1]x", []), (r"^1\.$", ["1."]),
])
def test_prefixes(pattern, want):
    assert LY.prefixes(pattern) == want


def test_prefixes_hold_for_every_match():
    rng = random.Random(2)
    pieces = ["1", "0", r"\.", ".", "[0-2]", "[12]", "[^0]", "2*", "1+", "0?", r"\d", "(10)", "(1)?", "{2}", "$", "^"]
    texts = ["".join(rng.choice("012.") for _ in range(rng.randrange(9))) for _ in range(400)]
    for _ in range(1500):
        pattern = "^" + "".join(rng.choice(pieces) for _ in range(rng.randrange(6)))
        try:
            test = re.compile(pattern)
        except re.error:
            continue
        begins = LY.prefixes(pattern)
        for t in texts:
            if begins and test.search(t):
                assert any(t.startswith(b) for b in begins), (pattern, t)


def scanned(found) -> int:
    """Rows that the scan gave, after the query has run."""
    leaves = found._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))


def traffic(n=40_000, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        remote = "10.0.0.1" if rng.random() < 0.3 else f"10.{rng.randrange(20)}.{rng.randrange(10)}.{rng.randrange(100)}"
        rows.append(packet(i, i % 500, rng.choice([">SYN", "<RST"]), ts=rng.randrange(10**9), remote=remote, host_port=rng.choice([22, 80, 443, *range(1000, 1200)])))
    return rows


def test_search_skips_files(spark, tmp_path):
    packets = table(spark, traffic()).repartition(4)
    LY.write_clustered(packets, str(tmp_path / "laid"), files=96)
    store = spark.read.parquet(str(tmp_path / "laid"))
    assert store.count() == 40_000 and set(store.columns) == set(packets.columns)
    wanted = {"source": r"^10\.1[0-3]\.2\.", "destination_port": 80}
    found = SE.find(store, **wanted)
    ids = sorted(r.packet_id for r in found.collect())
    assert ids and ids == sorted(r.packet_id for r in SE.find(packets, **wanted).collect())
    pushed = found._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metadata().apply("PushedFilters")
    assert "StringStartsWith(source_address,10.10.2.)" in pushed and "EqualTo(destination_port,80)" in pushed
    assert scanned(found) <= 5_000  # 4 171 when this was written
    early = store.where("timestamp < 50000000 and destination_port = 443")
    assert early.collect() and scanned(early) <= 8_000


def test_hot_place_is_spread_and_odd_rows_stay(spark, tmp_path):
    rows = [packet(i, 1, ">SYN", ts=i) for i in range(2000)]
    rows += [(*rows[0][:3], None, None, None, None, *rows[0][7:])] * 3
    packets = table(spark, rows)
    LY.write_clustered(packets, str(tmp_path / "hot"), files=8)
    store = spark.read.parquet(str(tmp_path / "hot"))
    sizes = [r["count"] for r in store.groupBy("_metadata.file_path").count().collect()]
    assert sum(sizes) == 2003 and len(sizes) == 8 and max(sizes) <= 2 * sorted(sizes)[4]
    LY.write_clustered(packets.limit(0), str(tmp_path / "none"), files=2)
    assert spark.read.schema(packets.schema).parquet(str(tmp_path / "none")).count() == 0
