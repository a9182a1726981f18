"""Command line: the reference's workflow as Spark jobs.

  python -m revlens list
  python -m revlens build-fact --tables DIR --out PATH [--budget-year 2000]
  python -m revlens profile --sheets CATALOG.json [--format csv]
  python -m revlens clean --sheets CATALOG.json --out PATH [--format csv] [--budget-year 2017]
  python -m revlens report NAME|all --fact PATH [--out DIR] [--format csv|parquet] [--show N]
                                    [--start DATE] [--end DATE]

``build-fact`` turns the TPC-H-style tables into the typed fact table;
``clean`` runs the six-sheet cleaning pipeline over a sheet catalogue
(``{"Sales Orders": path, ...}``); ``report`` runs reports on a stored fact
and writes each to ``OUT/<name>`` (a directory of part files) or shows it.
Run under ``spark-submit`` on a cluster (the session comes from the
environment); ``--master`` is for local runs.
"""

from __future__ import annotations

import argparse
import inspect
import json
import sys

from pyspark.sql import SparkSession

from revlens.plans.registry import DERIVED, REPORTS
from revlens.session import RECOMMENDED_CONF, ensure_checkpoint_dir

REPORT_FUNCS = {**{k: v.__wrapped__ for k, v in REPORTS.items()},
                **{k: v.__wrapped__ for k, v in DERIVED.items()}}


def _session(master: str | None) -> SparkSession:
    builder = SparkSession.builder.appName("revlens")
    if master:
        builder = builder.master(master)
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def _write(df, path: str, fmt: str) -> None:
    from revlens.sources.sinks import write_csv
    if fmt == "csv":
        write_csv(df, path)
    else:
        df.write.mode("overwrite").parquet(path)


def report_params(report, args) -> dict:
    """The options given that the report has a parameter for."""
    from revlens.plans.products import ABC_CUTS
    known = inspect.signature(report).parameters
    given = {}
    if args.years or "years" in known:
        given["years"] = args.years or [2014, 2015, 2016, 2017]
    if args.top is not None:
        given["n"] = args.top
    if args.recency:
        given["recency_bounds"] = tuple(args.recency)
    if args.abc_cuts:
        given["cuts"] = tuple((cut, label) for cut, (_, label) in zip(args.abc_cuts, ABC_CUTS))
    unknown = sorted(set(given) - set(known))
    if unknown:
        raise SystemExit(f"the report has no parameter {unknown}")
    return given


def main(argv=None) -> int:
    parser = argparse.ArgumentParser(prog="revlens", description=__doc__.splitlines()[0])
    parser.add_argument("--master", default=None, help="Spark master for local runs")
    sub = parser.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list", help="list report names")

    bf = sub.add_parser("build-fact", help="driver tables -> typed fact table")
    bf.add_argument("--tables", required=True)
    bf.add_argument("--out", required=True)
    bf.add_argument("--budget-year", type=int, default=2000)

    cl = sub.add_parser("clean", help="six raw sheets -> typed fact table")
    cl.add_argument("--sheets", required=True, help="JSON file: sheet name -> path")
    cl.add_argument("--out", required=True)
    cl.add_argument("--format", default="csv", choices=["csv", "parquet"])
    cl.add_argument("--budget-year", type=int, default=2017)
    cl.add_argument("--no-round", action="store_true", help="keep unrounded money columns")
    cl.add_argument("--state-header", default="State Code,Region",
                    help="header values found in the first data row of State Regions "
                         "('none' when the sheet has a proper header)")

    ld = sub.add_parser("load", help="exported CSV -> gated fact table and quarantine")
    ld.add_argument("--csv", required=True)
    ld.add_argument("--out", required=True)
    ld.add_argument("--quarantine", default=None,
                    help="folder of the rejected rows (default: with the table)")

    pf = sub.add_parser("profile", help="rows, columns, null cells and duplicates per sheet")
    pf.add_argument("--sheets", required=True, help="JSON file: sheet name -> path")
    pf.add_argument("--format", default="csv", choices=["csv", "parquet"])

    rp = sub.add_parser("report", help="run reports on a stored fact table")
    rp.add_argument("name", help="report name or 'all'")
    rp.add_argument("--fact", required=True)
    rp.add_argument("--out", default=None)
    rp.add_argument("--format", default="csv", choices=["csv", "parquet"])
    rp.add_argument("--show", type=int, default=0, help="print the first N rows")
    rp.add_argument("--parallel", type=int, default=4,
                    help="reports run side by side (concurrent Spark jobs)")
    rp.add_argument("--start", default=None, help="first order date (partition pruning)")
    rp.add_argument("--end", default=None, help="last order date (inclusive)")

    rp.add_argument("--years", type=int, nargs="+", default=None,
                    help="years of the month x year pivot (b16; default 2014-2017)")
    rp.add_argument("--top", type=int, default=None, help="products listed (b03, b04; default 10)")
    rp.add_argument("--recency", type=int, nargs=4, default=None, metavar="DAYS",
                    help="bounds of the recency scores 5, 4, 3, 2 (b10, d3; default 0 2 5 9)")
    rp.add_argument("--abc-cuts", nargs=2, default=None, metavar="SHARE",
                    help="running shares that end classes A and B (b18, d7; default 0.70 0.90)")

    args = parser.parse_args(argv)
    if args.cmd == "list":
        print("\n".join(REPORT_FUNCS))
        return 0

    spark = _session(args.master)
    if args.cmd == "build-fact":
        from revlens.sources.sinks import write_sales_table
        from revlens.sources.tables import sales_fact
        write_sales_table(sales_fact(spark, args.tables, budget_year=args.budget_year), args.out)
    elif args.cmd == "clean":
        from revlens.operators.joins import JoinWatch
        from revlens.operators.ordered import materialize
        from revlens.operators.quality import split_by_reasons, with_reasons
        from revlens.plans.enrichment import clean_sales
        from revlens.sources.sheets import REQUIRED_SHEETS, load_sheets
        from revlens.sources.sinks import write_sales_table
        with open(args.sheets) as fh:
            catalog = json.load(fh)
        required = [s for s in REQUIRED_SHEETS if "Budgets" not in s]
        sheets = load_sheets(spark, catalog, fmt=args.format, required=required)
        header = None if args.state_header.lower() == "none" else tuple(
            args.state_header.split(","))
        watch = JoinWatch()
        fact = clean_sales(sheets, budget_year=args.budget_year, state_header=header,
                           round_money_cols=not args.no_round, watch=watch, on_duplicate="watch")
        # the joins run once; the gate's verdict and the table read their result
        accepted, rejected = split_by_reasons(materialize(with_reasons(fact)))
        for c in watch.counts():
            print(f"{c.name}: {c.rows_in} rows in, {c.rows_out} out, {c.unmatched} without a match, "
                  f"{c.null_keys} without a key")
        watch.check()
        bad = rejected.select("reasons").limit(1).collect()
        if bad:
            raise ValueError("; ".join(filter(None, [f"validation failed: {bad[0]['reasons']}",
                                                     watch.lost()])))
        write_sales_table(accepted, args.out)
    elif args.cmd == "load":
        from revlens.sources.sheets import load_gated_csv
        from revlens.sources.sinks import publish_load
        publish_load(*load_gated_csv(spark, args.csv), args.out, args.quarantine)
    elif args.cmd == "profile":
        from revlens.operators.quality import profile_sheets
        from revlens.sources.sheets import load_sheets
        with open(args.sheets) as fh:
            catalog = json.load(fh)
        profile_sheets(load_sheets(spark, catalog, fmt=args.format)).show(truncate=False)
    elif args.cmd == "report":
        from revlens.sources.sinks import read_sales_table
        sales = read_sales_table(spark, args.fact, start=args.start, end=args.end)
        names = list(REPORT_FUNCS) if args.name == "all" else [args.name]
        given = [o for o in ("years", "top", "recency", "abc_cuts") if getattr(args, o)]
        if given and args.name == "all":
            parser.error(f"{given} are for a report on its own")
        unknown = [n for n in names if n not in REPORT_FUNCS]
        if unknown:
            parser.error(f"unknown report(s): {unknown}; see 'revlens list'")
        def act(name, df):
            if args.out:
                at = f"{args.out.rstrip('/')}/{name}"
                df = df.persist() if args.show else df
                _write(df, at, args.format)
            shown = df.take(args.show) if args.show else None
            df.unpersist()
            return shown

        if len(names) > 1:          # whole catalogue: each grain aggregated once
            from revlens.plans.suite import execute_reports
            shown = execute_reports(sales, act, names, parallel=args.parallel)
        else:
            report = REPORT_FUNCS[names[0]]
            shown = {names[0]: act(names[0], report(sales, **report_params(report, args)))}
        for name, rows in shown.items():
            if rows is not None:
                print(f"== {name}")
                for row in rows:
                    print(row)
    return 0


if __name__ == "__main__":
    sys.exit(main())
