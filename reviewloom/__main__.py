"""Command line: ``python -m reviewloom JOB --reviews PATH --games PATH --out DIR``."""

from __future__ import annotations

import argparse

from reviewloom.plans.jobs import JOBS
from reviewloom.session import session_builder


def main() -> None:
    parser = argparse.ArgumentParser(prog="reviewloom")
    jobs = parser.add_subparsers(dest="job", required=True)
    for name, (function, arguments) in JOBS.items():
        job = jobs.add_parser(name, help=function.__doc__)
        for argument in arguments:
            job.add_argument(f"--{argument}", required=True)
    given = vars(parser.parse_args())
    function, _ = JOBS[given.pop("job")]
    spark = session_builder().getOrCreate()
    function(spark, **given)
    spark.stop()


if __name__ == "__main__":
    main()
