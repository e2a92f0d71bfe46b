"""Times the detection steps on the packets of $BENCH_SF_DIR; prints one JSON line.

Packets are first landed as a Parquet table (not timed), as a capture would be.
Each step starts from the table the step before it has written; the median of
three warm runs counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


from flowwatch.operators import alerts as AL
from flowwatch.operators import features as FE
from flowwatch.operators import flows as FL
from flowwatch.operators import model as MO
from flowwatch.operators import reports as RP
from flowwatch.operators import verdicts as VD
from flowwatch.plans import detect as DE
from flowwatch.session import local_session, scratch_path
from flowwatch.sources import traffic as T
from flowwatch.streaming import detect as ST

RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus), memory=os.environ.get("BENCH_MEMORY", "8g"))
    spark.sparkContext.setLogLevel("ERROR")

    def table(rows, name, parts=None):
        path = scratch_path(spark, name)
        (rows.repartition(parts) if parts else rows).write.parquet(path)
        return spark.read.parquet(path), path

    packets, landing = table(T.packets(spark, sf_dir), "packets", int(cpus))
    verdicts, _ = table(DE.verdicts(packets), "verdicts")
    history, _ = table(VD.history(verdicts), "history")
    features, _ = table(FE.snapshot(history).join(T.source_labels(spark, sf_dir), "source"), "features")
    model = MO.train(MO.split(features)[0])
    decided, _ = table(DE.decide(verdicts, model), "decided")
    alerts, _ = table(AL.direct(verdicts).unionByName(AL.scored(decided)), "alerts")

    def run(rows):
        rows.write.format("noop").mode("overwrite").save()

    def stream():
        store = ST.FlowStore(scratch_path(spark, "flow-store"))
        ST.record(ST.packet_stream(spark, landing, files_per_trigger=4), store, scratch_path(spark, "offsets")).awaitTermination()

    steps = {
        "flow_assembly": lambda: run(FL.assemble(packets)),
        "flow_assembly_no_count": lambda: run(FL.assemble(packets, hot="none")),
        "flow_assembly_sliced": lambda: run(FL.assemble(packets, hot="sliced")),
        "verdict_cascade": lambda: run(DE.verdicts(packets).select(*FL.KEYS, "verdict")),
        "features": lambda: run(FE.snapshot(history)),
        "features_as_of": lambda: run(FE.as_of(history)),
        "scoring": lambda: run(DE.decide(verdicts, model).select(*FL.KEYS, "outcome", "chance")),
        "alert_roll_up": lambda: run(RP.roll_up(alerts, source_ports=AL.scanned_ports(history))),
        "network_alerts": lambda: run(AL.direct(
            VD.network_alerts(FL.assemble(packets), T.honeypot_sources(spark, sf_dir)))),
        "packets_to_alerts": lambda: run(DE.detect(packets, model).alerts),
        "stream_available_now": stream,
    }
    seconds = {}
    for name, step in steps.items():
        times = []
        for _ in range(RUNS + 1):  # the first run warms up
            start = time.time()
            step()
            times.append(time.time() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(name, [round(t, 2) for t in times], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "packets_to_alerts_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
        "packets": packets.count(), "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
