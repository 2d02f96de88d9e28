"""Times headline queries and prints one line of JSON.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parent}:{os.environ.get('PYTHONPATH', '')}"

HEADLINES = (
    "term_frequency", "freq_grouping_sets", "lix_rix", "mattr", "speaker_weighted_lix", "sentiment_negation", "emotion_rates", "salience_stance",
    "bigram_npmi", "connector_bigrams", "keyness_ll", "rank_turbulence", "event_summary", "speaker_reaction_scores", "graph_degrees", "graph_rollup",
    "name_resolution", "topic_speaker_association", "labelling_agreement", "keyword_in_context", "cooccurrence_edges", "textrank", "tree_distance", "window_distributions",
)


def main() -> None:
    from rostrum.plans import catalogue
    from rostrum.session import session

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="12g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    took = {}
    for name in HEADLINES:
        start = time.perf_counter()
        catalogue.queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
