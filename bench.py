"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables and BENCH_CPUS the cores. Each query runs twice, from
reading the tables to its last row; the second run counts, as the first also pays for
starting the JVM and compiling. Rows go nowhere, so no result is collected.
"""

from __future__ import annotations

import json
import os
import re
import time

from catalog.queries import QUERIES
from mailveil.session import local_session

HEADLINE = (
    "message_record", "csv_batches", "mask_message", "synthetic_message", "mask_text_files",
    "entity_totals", "detect_person", "validated_score", "pseudonym_messages",
    "mapping_merge", "first_seen_address", "html_to_text", "body_select", "header_fields",
    "batch_number", "folder_messages", "custom_recognizer", "synthetic_redetect",
)


def run(spark, folder: str, name: str) -> float:
    start = time.time()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return round(time.time() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    first, second = {}, {}
    for name in HEADLINE:
        first[name] = run(spark, folder, name)
        second[name] = run(spark, folder, name)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "total seconds of the headline queries, second run",
        "value": round(sum(second.values()), 3), "unit": "sec", "queries": second,
        "first_run": first, "sf": float(scale.group(1)) if scale else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
