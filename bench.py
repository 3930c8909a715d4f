"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

from chapterloom.plans import workloads
from chapterloom.session import local_session

HEADLINE = (
    "page_source site_route entry_id slugify novel_metadata html_to_text sanitize_html content_status "
    "catalog_links catalog_merge select_explicit cap_chapters fetch_frontier completed_prefix book_archive "
    "library_upsert update_all import_status event_seq job_state download_running skip_collapse run_due"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "chapterloom-bench")
    queries = workloads.queries()
    # One page through the tokeniser starts the Python workers; not timed.
    queries["html_nodes"](spark, folder).count()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline query time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
