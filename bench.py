"""Headline queries, timed to a full write of their results. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from leafvoice.registry import QUERIES  # noqa: E402
from leafvoice.session import local_session  # noqa: E402

HEADLINE = [
    "narration_chapters", "build_chapters", "build_web_chapters", "split_sentences", "split_sentences_unicode",
    "clean_for_speech", "lines_to_paragraphs", "merge_drop_caps", "to_paragraphs", "choose_sections", "explode_words",
    "sentence_audit", "corpus_audit", "neighbour_targets", "chapter_position", "skip_seconds", "library_overview",
    "latest_progress", "coalesce_updates", "interpolate_position", "detect_stalls", "sessionize_playback",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, "leafvoice-bench", tempfile.mkdtemp(prefix="run-"))
    names = sys.argv[1:] or HEADLINE
    run = lambda name: QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    run(names[-1])  # start the workers
    took = {}
    for name in names:
        start = time.perf_counter()
        run(name)
        took[name] = round(time.perf_counter() - start, 3)
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    out = {"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf)}
    if "build_chapters" in took:
        out["documents_per_sec"] = round(docs / took["build_chapters"], 1)
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
