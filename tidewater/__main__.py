"""Command line for the scheduled runs, e.g. with spark-submit:

    spark-submit --py-files tidewater.zip tidewater/__main__.py etl --raw RAW --out OUT --as-of 2001-11-05
    python -m tidewater insights --processed ... --out ... --as-of ...
    python -m tidewater documents --processed ... --out ... --as-of ...
    python -m tidewater ingest --src ... --dest ... --checkpoint ... --kind ecc
    python -m tidewater alerts --events ... --out ... --checkpoint ... [--rule failure]

Each prints one JSON status line.  The session comes from the submit
environment; ``--master`` is only for local runs.
"""

from __future__ import annotations

import argparse
import json

from tidewater.session import apply_sizing, get_session


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="tidewater")
    ap.add_argument("--master", default=None)
    sub = ap.add_subparsers(dest="job", required=True)
    e = sub.add_parser("etl", help="consolidate raw exports into customers, products, sales")
    e.add_argument("--raw", required=True)
    e.add_argument("--out", required=True)
    e.add_argument("--as-of", required=True)
    e.add_argument("--lookback-days", type=int, default=7)
    e.add_argument("--sales-mode", choices=["append", "replace_window"], default="replace_window")
    e.add_argument("--unit-price-mode", choices=["reference", "ecc_only"], default="reference")
    i = sub.add_parser("insights", help="five reports as insight rows")
    i.add_argument("--processed", required=True)
    i.add_argument("--out", required=True)
    i.add_argument("--as-of", required=True)
    i.add_argument("--days", type=int, default=30)
    d = sub.add_parser("documents", help="rebuild the document set")
    d.add_argument("--processed", required=True)
    d.add_argument("--out", required=True)
    d.add_argument("--as-of", required=True)
    d.add_argument("--days", type=int, default=30)
    g = sub.add_parser("ingest", help="land new CSV export files (streaming, availableNow)")
    g.add_argument("--src", required=True)
    g.add_argument("--dest", required=True)
    g.add_argument("--checkpoint", required=True)
    g.add_argument("--kind", choices=["ecc", "bw"], required=True)
    g.add_argument("--as-of", default=None, help="processing time of the rows (default: now)")
    g.add_argument("--rename", action="append", default=[], metavar="HEADER=COLUMN", help="for other layouts")
    a = sub.add_parser("alerts", help="sliding-window alert stream over event files")
    a.add_argument("--events", required=True)
    a.add_argument("--out", required=True)
    a.add_argument("--checkpoint", required=True)
    a.add_argument("--rule", choices=["error", "failure"], default="error")
    args = ap.parse_args(argv)

    spark = get_session(master=args.master)
    inputs = {"etl": "raw", "insights": "processed", "documents": "processed", "ingest": "src",
              "alerts": "events"}[args.job]
    apply_sizing(spark, getattr(args, inputs))
    from tidewater.plans import jobs
    if args.job == "etl":
        out = jobs.run_etl(spark, args.raw, args.out, as_of=args.as_of, lookback_days=args.lookback_days,
                           sales_mode=args.sales_mode, unit_price_mode=args.unit_price_mode)
    elif args.job == "insights":
        out = jobs.run_insights(spark, args.processed, args.out, as_of=args.as_of, days=args.days)
    elif args.job == "documents":
        out = jobs.run_documents(spark, args.processed, args.out, as_of=args.as_of, days=args.days)
    elif args.job == "ingest":
        from tidewater.streaming import jobs as st
        st.ingest_csv(spark, args.src, args.dest, args.checkpoint, args.kind, as_of=args.as_of,
                      rename=dict(x.split("=", 1) for x in args.rename)).awaitTermination()
        out = {"ingested": True}
    else:
        from tidewater.streaming import jobs as st
        size, slide, threshold = st.ERROR_RULE if args.rule == "error" else st.FAILURE_RULE
        q = st.run_to_table(st.streaming_alerts(st.read_event_stream(spark, args.events), size=size,
                                                slide=slide, threshold=threshold),
                            args.out, args.checkpoint)
        q.awaitTermination()
        out = {"alerts": True}
    print(json.dumps(out, default=str))


if __name__ == "__main__":
    main()
