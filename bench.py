"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (input folder), BENCH_CPUS (local cores).
Every query is run to its last row into the no-op sink. The stages the queries
share (normalised documents, dictionary, bag of words) are written once and
timed under their own names, first.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from topicloom.plans import catalog, corpora  # noqa: E402
from topicloom.runtime import session  # noqa: E402

SHARED = {"stage_docs": corpora.docs, "stage_dictionary": corpora.dictionary,
          "stage_terms": corpora.terms, "stage_bow": corpora.bow, "stage_vectors": corpora.model_vectors}
HEADLINE = [
    "scan_posts", "newest_posts", "batch_numbers", "clean_posts", "main_content", "paragraphs", "sentences",
    "tokens", "pos_tags", "flatten_docs", "clean_raw_join", "per_year_limit", "lemmas", "normalise_docs",
    "stem_tokens", "frequent_terms", "bigram_counts", "phrase_scores", "ngram_docs", "dictionary_pruned",
    "bow", "tfidf", "doc_vectors", "assign_nearest", "cluster_words", "kmeans_cosine", "lda_fit", "lsa_fit",
    "coherence_umass", "coherence_cv", "topic_relevance", "topic_distance", "topic_clusters", "foldin_topics",
    "document_topics", "topic_trend",
]


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", "bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads
    times: dict[str, float] = {}
    for name, run in {**SHARED, **{name: catalog.QUERIES[name] for name in HEADLINE}}.items():
        start = time.perf_counter()
        result = run(spark, directory)
        if name not in SHARED:
            result.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(directory.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
