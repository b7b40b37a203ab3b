"""A whole training run from the command line:

    spark-submit gridwarden/train.py --feed '/data/feed/*.csv' --artifacts /data/artifacts [--force-promote]
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))  # when run as a script

from gridwarden.config import Settings, load_rules  # noqa: E402
from gridwarden.plans.training import run_training  # noqa: E402
from gridwarden.session import build_session  # noqa: E402
from gridwarden.sources.feed import read_feed  # noqa: E402


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description="Train on a feed and register the run.")
    parser.add_argument("--feed", required=True, help="path or pattern of the feed")
    parser.add_argument("--format", default="csv", choices=["csv", "parquet"], help="of the feed")
    parser.add_argument("--artifacts", required=True, help="folder of the runs, shared by all executors")
    parser.add_argument("--rules", help="YAML file of severity and vehicle rules")
    parser.add_argument("--force-promote", action="store_true", help="promote the run whatever its error")
    return parser.parse_args(argv)


def main(argv: list[str] | None = None) -> dict:
    """Returns the registry row; prints whether the run was promoted, and why."""
    asked = arguments(argv)
    settings = load_rules(Settings(), asked.rules) if asked.rules else Settings()
    spark = build_session("gridwarden-train")
    feed = read_feed(spark, asked.format, asked.feed, settings)
    row = run_training(feed, asked.artifacts, settings, force_promote=asked.force_promote)
    gate = row["promotion_gate"]
    print(f"{row['run_id']}: {'promoted' if gate['promoted'] else 'not promoted'}: {gate['reason']}")
    return row


if __name__ == "__main__":
    main()
