"""Command line: python -m plyforge COMMAND ...; each command is a job of plyforge.plans.jobs or a stream."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from plyforge.functions import scores
from plyforge.plans import jobs
from plyforge.session import build_session
from plyforge.sources import games as sources
from plyforge.streaming import ingest


#: The default edges of rating statistics.
RATING_EDGES = [0, 1000, 1200, 1400, 1600, 1800, 2000, 2200, 2400, 2600, 4000]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="plyforge")
    sub = p.add_subparsers(dest="command", required=True)

    c = sub.add_parser("ingest", help="parse dumps that land in a folder into rating buckets, each file once")
    for name in ("landing", "out", "ledger", "checkpoint"):
        c.add_argument(name)
    c.add_argument("--files-per-batch", type=int, default=2)
    c.add_argument("--min-seconds", type=int, default=60)
    c.add_argument("--archive", help='where files go that are done, outside landing; or "delete"')
    c.add_argument("--stop-file", help="ends the stream once this file is there")
    c.add_argument("--poll", help='as "60 seconds"; without it the command ends when nothing is left')

    c = sub.add_parser("build", help="a balanced, oversampled and split dataset from a bucket tree")
    c.add_argument("root")
    c.add_argument("out")
    c.add_argument("--min-timectl", type=int, required=True)
    c.add_argument("--min-rows", type=int, default=1)
    c.add_argument("--max-repeats", type=int, default=10)
    c.add_argument("--valp", type=int, default=5)
    c.add_argument("--testp", type=int, default=5)
    c.add_argument("--seed", type=int, default=42)
    c.add_argument("--batch-size", type=int, default=0, help="rows of a file at most; 0: no bound")

    c = sub.add_parser("merge", help="roll buckets up at a threshold")
    c.add_argument("root")
    c.add_argument("out")
    c.add_argument("threshold", type=int)
    c.add_argument("--dry-run", action="store_true")

    c = sub.add_parser("split", help="split every file below a folder by chunks")
    c.add_argument("root")
    c.add_argument("out")
    c.add_argument("--valid", type=float, default=0.05)
    c.add_argument("--test", type=float, default=0.05)
    c.add_argument("--seed", type=int, default=42)

    c = sub.add_parser("concat", help="all readable Parquet files below a folder as one table; tells which gave no row")
    c.add_argument("root")
    c.add_argument("out")

    c = sub.add_parser("stats", help="rating, pair and time statistics and whitening parameters of a bucket tree")
    c.add_argument("root")
    c.add_argument("--elo-edges", type=float, nargs="+", default=RATING_EDGES)
    c.add_argument("--metadata", help="a JSON document that takes the whitening parameters")

    c = sub.add_parser("fens", help="the first positions of each game as text")
    c.add_argument("root")
    c.add_argument("out")
    c.add_argument("--per-game", type=int, default=20)
    c.add_argument("--skew", type=int, help="sample from a random place on, later places being likelier, instead of the first positions")

    c = sub.add_parser("budget", help="the missing one of compute rate, days, parameters and tokens")
    c.add_argument("--tau", type=float, help="1e12 operations a second")
    c.add_argument("--days", type=float)
    c.add_argument("--params", type=float, help="millions")
    c.add_argument("--tokens", type=float, help="billions")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    if a.command == "budget":
        print(scores.compute_budget(a.tau, a.days, a.params, a.tokens))
        return
    spark = build_session()
    if a.command == "ingest":
        stream = ingest.ingest(spark, a.landing, a.out, a.ledger, a.checkpoint, a.files_per_batch, a.poll, a.min_seconds, a.archive)
        ingest.run_until(spark, stream, a.stop_file) if a.stop_file else stream.awaitTermination()
    elif a.command == "build":
        jobs.build_dataset(spark, a.root, a.out, a.batch_size, min_time=a.min_timectl, min_rows=a.min_rows, max_repeats=a.max_repeats, valid=a.valp, test=a.testp, seed=a.seed)
    elif a.command == "merge":
        jobs.merge_tree(spark, a.root, a.out, a.threshold, a.dry_run).show(1000, False)
    elif a.command == "split":
        jobs.split_files(spark, a.root, a.out, a.valid, a.test, a.seed)
    elif a.command == "concat":
        for r in jobs.concat(spark, a.root, a.out).toLocalIterator():
            print(f"no rows read from {r.file} ({r.bytes} bytes)")
    elif a.command == "stats":
        found = jobs.statistics(sources.read_bucket_tree(spark, a.root), a.elo_edges)
        for name, df in found.items():
            print(name)
            df.show(1000, False)
        if a.metadata:
            row = found["whitening"].first()
            sources.update_metadata(spark, a.metadata, elo_mean=row["mean"], elo_std=row["std"])
    elif a.command == "fens":
        games = sources.read_bucket_tree(spark, a.root).select(F.xxhash64("moves", "welo", "belo").alias("game_id"), "moves")
        chosen = jobs.sampled_positions(games, "game_id", a.per_game, skew=a.skew) if a.skew else jobs.positions(games, "game_id", a.per_game)
        sources.write_lines(chosen, "fen", a.out)


if __name__ == "__main__":
    main()
