"""Time the headline queries and print one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from termflow.plans import load_all  # noqa: E402
from termflow.session import build_session  # noqa: E402

HEADLINE = [
    "term_coverage", "term_frequency", "supplemented_terms", "merged_glossary", "glossary_adherence", "first_term_use",
    "asr_variants_removed", "cleaned_terms", "upserted_library", "general_segments", "slide_segments", "marked_payloads",
    "parsed_replies", "translated_blocks", "review_diffs", "bilingual_first_use", "constraint_texts", "text_paragraphs",
    "markdown_blocks", "json_strings", "html_blocks", "job_rollup", "stage_timing", "version_history", "token_estimate",
    "live_job_rollup",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = load_all()
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    seconds, failed = {}, {}
    for name in sys.argv[1:] or HEADLINE:
        t = time.time()
        try:
            queries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        except Exception as e:  # the other queries are still timed
            failed[name] = f"{type(e).__name__}: {str(e)[:300]}"
            print(name, failed[name], file=sys.stderr, flush=True)
            continue
        seconds[name] = round(time.time() - t, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total query time", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), **({"failed": failed} if failed else {})}))


if __name__ == "__main__":
    main()
