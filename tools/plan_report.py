"""Summarise the physical plan of every catalogue query (markdown table).

For each query: parquet scans, shuffles (Exchange), broadcasts, join
strategies, aggregate kinds, and Python evaluation nodes, read from the
final adaptive plan after one run.

    python tools/plan_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import io
import os
import re
import sys
from contextlib import redirect_stdout

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from runledger.plans import catalog  # noqa: E402
from runledger.session import local_session  # noqa: E402

JOINS = ["BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin",
         "CartesianProduct"]


def formatted(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def read_columns(text: str) -> str:
    """Columns each scan reads (ReadSchema), to show pruning."""
    out = []
    for schema in sorted(set(re.findall(r"ReadSchema: struct<([^\n]*)>", text))):
        out.append(",".join(f.split(":")[0] for f in re.split(r",(?![^<]*>)", schema)))
    return " / ".join(out) or "-"


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session()
    print(f"# Physical plans at {os.path.basename(sf)} (final adaptive plans, `local[8]`)\n")
    print("| query | scans | shuffles | broadcasts | joins | aggregates | Python | columns read |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- |")
    for name, q in catalog.Q.items():
        df = q(spark, sf)
        df.write.format("noop").mode("overwrite").save()
        text = formatted(df)
        final = text.split("\n\n(1)")[0].split("+- == Initial Plan ==")[0]
        scans = final.count("Scan parquet") + final.count("Scan binaryFile") + final.count("Scan json")
        # \bExchange\b matches neither BroadcastExchange nor ReusedExchange.
        shuffles = len(re.findall(r"\bExchange\b", final))
        bcast = final.count("BroadcastExchange")
        joins = ", ".join(f"{j.replace('Join', '')} {final.count(j)}" for j in JOINS if j in final) or "-"
        aggs = ", ".join(f"{a} {final.count(a + ' ')}" for a in
                         ("HashAggregate", "SortAggregate", "ObjectHashAggregate")
                         if final.count(a + " ")) or "-"
        py = "yes" if ("EvalPython" in final or "ArrowEvalPython" in final) else "no"
        print(f"| {name} | {scans} | {shuffles} | {bcast} | {joins} | {aggs} | {py} | {read_columns(text)} |")
    spark.stop()


if __name__ == "__main__":
    main()
