"""Times the headline queries on the given tables and prints one JSON line.

Every query is run to the end with the ``noop`` sink, so all rows and columns are computed and nothing is collected. A table that
lies in one file with one row group can only be read by one task, so the tables of texts are first laid out in as many files as
there are cores, as a loader would; that is not timed.
"""

from __future__ import annotations

import atexit
import json
import os
import shutil
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "t1_search_text t2_search_rerank x25_search_snippet j1_point_lookup j2_page_assets j3_asset_audit j7_alias_resolution j13_link_backfill "
    "j18_block_hydration a1_stage_status_counts a10_cluster_membership w1_next_job w3_best_link w7_next_revision g1_include_edges g2_template_closure "
    "g3_crawl_frontier g4_link_graph x1_html_to_text x2_internal_links x9_segments x10_page_blocks x14_source_features x21_markup_cells x35_relation_candidates "
    "v2_structure_preservation v4_syntax_leaks v6_readiness v7_integration_qa m1_text_similarity m3_fidelity_score r1_rate_limit r9_tumbling_counts_stream"
).split()


TEXT_TABLES = ("documents", "pages", "conversations")


def laid_out(spark, sf: str, cpus: int) -> str:
    """A folder with the same tables, those of texts in ``cpus`` files."""
    out = tempfile.mkdtemp(prefix="bench-")
    atexit.register(shutil.rmtree, out, ignore_errors=True)
    for name in os.listdir(sf):
        table = name.removesuffix(".parquet")
        if table in TEXT_TABLES:
            spark.read.parquet(f"{sf}/{name}").repartition(cpus).write.parquet(f"{out}/{name}")
        else:
            os.symlink(os.path.abspath(f"{sf}/{name}"), f"{out}/{name}")
    return out


def main() -> None:
    from wikimill.plans import QUERIES
    from wikimill.session import build_session, clear_work

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", int(cpus), "20g")
    spark.sparkContext.setLogLevel("ERROR")
    tables = laid_out(spark, sf, int(cpus))  # start-up cost stays out of the first query
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, tables).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        clear_work(spark)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
