"""``python -m engramspark.cli``: run the benchmark on a dataset file."""

from __future__ import annotations

import argparse
from datetime import date

from . import get_session
from .operators.evaluation import accuracy_by_type, select_items
from .plans.evaluate import run_evaluation
from .sources.dataset import dataset_path, load_dataset, turns_of, write_results
from .sources.providers import ProviderRegistry


def parse(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--count", default="5", help="items per question type, or 'all'")
    p.add_argument("--type", default=None, help="only this question type")
    p.add_argument("--dataset", default="oracle", help="'s' or 'oracle'")
    p.add_argument("--folder", default="data")
    p.add_argument("--out", default="results")
    return p.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    args, providers = parse(argv), ProviderRegistry()
    spark = get_session()
    items = load_dataset(spark, dataset_path(args.folder, args.dataset))
    count = None if args.count == "all" else int(args.count)
    chosen = select_items(items, count, args.type)
    run = run_evaluation(
        chosen, turns_of(chosen), providers["extractor"], providers["embedder"], providers["judge"],
        triple_filter=providers["triple_filter"],
    )
    write_results(run.results.select("question_id", "question_type", "question", "generated_answer", "correct",
                                     "passages", "entities", "facts"),
                  args.out, args.dataset, date.today().isoformat())
    accuracy_by_type(run.results).show(truncate=False)


if __name__ == "__main__":
    main()
