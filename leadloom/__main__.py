"""The command line: queries over a folder of tables, and entries of lists."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leadloom.plans import analytics, lifecycle, pages, people, preparation, scoring, shapes  # noqa: F401 (some only register their queries)
from leadloom.session import local_session
from leadloom.sources.files import append_log, write_csv

#: commands that show one query
SHOWN = {"metrics": "coverage_metrics", "golden-set": "golden_set_accuracy", "canary": "drift_reasons"}


def known_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return preparation.QUERIES | analytics.QUERIES


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="leadloom", description=__doc__)
    todo = top.add_subparsers(dest="command", required=True)
    todo.add_parser("queries", help="the names of all queries")
    run = todo.add_parser("run", help="one query, shown or written")
    run.add_argument("name", choices=sorted(known_queries()))
    discover = todo.add_parser("discover", help="the published leads of all companies as CSV")
    discover.add_argument("--out", required=True)
    for name in (run, discover, *[todo.add_parser(c, help=f"the result of {q}") for c, q in SHOWN.items()]):
        name.add_argument("--data", required=True, help="folder of the parquet tables")
    run.add_argument("--out", help="folder to write to")
    run.add_argument("--format", choices=("parquet", "json", "csv"), default="parquet")
    deny = todo.add_parser("denylist-add", help="a domain that is not to be approached")
    deny.add_argument("domain")
    suppress = todo.add_parser("suppress-lead", help="a person who is not to be approached: --email, or --name and --domain")
    for option in ("--email", "--name", "--domain"):
        suppress.add_argument(option, default="")
    for name in (deny, suppress):
        name.add_argument("--log", required=True, help="folder of the JSON-lines log")
    return top


def contact_key(email: str, name: str, domain: str) -> str:
    """The key of ``functions.postings.contact_key``; a person needs an address, or name and domain."""
    if email.strip():
        return f"email:{email.strip().lower()}"
    if not (name.strip() and domain.strip()):
        raise SystemExit("suppress-lead needs --email, or --name and --domain")
    return f"name:{name.strip().lower()}@{domain.strip().lower()}"


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    asked = parser().parse_args(arguments)
    if asked.command == "queries":
        print("\n".join(sorted(known_queries())))
        return
    key = contact_key(asked.email, asked.name, asked.domain) if asked.command == "suppress-lead" else None
    spark = spark or local_session()
    if asked.command == "denylist-add":
        append_log(spark.createDataFrame([(asked.domain.strip().lower(),)], "domain string"), asked.log)
    elif asked.command == "suppress-lead":
        append_log(spark.createDataFrame([(key,)], "contact_key string"), asked.log)
    elif asked.command == "discover":
        write_csv(known_queries()["published_leads"](spark, asked.data), asked.out)
    else:
        result = known_queries()[SHOWN.get(asked.command) or asked.name](spark, asked.data)
        if getattr(asked, "out", None):
            result.write.format(asked.format).option("header", True).mode("overwrite").save(asked.out)
        else:
            result.show(50, truncate=False)


if __name__ == "__main__":
    main()
