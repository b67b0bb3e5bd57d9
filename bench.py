"""Time the headline queries and print one JSON line.

BENCH_SF_DIR: table folder (default /root/testdata/sf0.1). BENCH_CPUS: cores (default 8).
Every query runs once untimed, so that class loading and code generation are not what is measured,
and once timed, from building its plan to the last row.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from ledgerloom.plans import catalog  # noqa: E402
from ledgerloom.plans.session import local_session  # noqa: E402

HEADLINE = (
    "statement_totals", "parse_roundtrip", "lines_greedy", "lines_grid", "doc_results", "statement_report",
    "amount_tokens", "text_rows", "entropy", "amount_clusters", "column_bounds", "ledger_stats", "daily_summary",
    "keyword_search", "balance_continuity", "running_balance", "duplicates", "golden_compare", "page_anomalies",
    "decisions", "corrections", "fingerprint", "learned_columns", "template_match", "inferred_sides", "ledger_as_of", "stream_intake",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "ledgerloom-bench")

    def run(name: str) -> float:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    for name in HEADLINE:
        run(name)
    seconds = {}
    for name in HEADLINE:
        seconds[name] = run(name)
        print(f"{name}: {seconds[name]}s", file=sys.stderr, flush=True)
    # Throughput of the full extraction: the word count is taken outside the timed runs.
    words = catalog.R.words(spark, sf_dir)
    n_words, n_docs = words.count(), words.select("doc_id").distinct().count()
    total = seconds["statement_totals"]
    print(json.dumps({
        "metric": "headline_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf"),
        "words": n_words, "documents": n_docs,
        "words_per_sec": round(n_words / total), "documents_per_sec": round(n_docs / total),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
