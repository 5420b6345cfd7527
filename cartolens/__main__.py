"""python -m cartolens COMMAND FOLDER: the steps of a crawl's analysis from a shell."""

from __future__ import annotations

import argparse
import signal
import sys
import threading
from pathlib import Path

from pyspark.sql import SparkSession

from .operators import store
from .operators.crawl import Budget, Stopped
from .plans import export, preflight
from .plans.run import Crawl


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("cartolens")
    p.add_argument("command", choices=["preflight", "inventory", "scan", "arcgis", "run-crawl", "status", "screenshots", "report"])
    p.add_argument("folder")
    p.add_argument("-c", "--config", help="YAML file")
    p.add_argument("-r", "--rules", help="YAML file")
    p.add_argument("--robots", help="robots.txt")
    p.add_argument("--org", help="id of the organisation whose items are cross-referenced")
    p.add_argument("--out", default="output")
    p.add_argument("--sample", type=int, default=12, help="of preflight: pages to look at")
    p.add_argument("--no-probe-keys", action="store_true")
    p.add_argument("--include-chrome-occurrences", action="store_true")
    p.add_argument("--no-crawl", action="store_true", help="of inventory: only what sitemaps and seeds list")
    p.add_argument("--tier", type=int, choices=[1, 2], help="of scan: only static detection, or only fusion")
    p.add_argument("--limit", type=int, help="of scan and run-crawl: pages that have not been scanned, at most")
    p.add_argument("--url", action="append", help="of scan: this page, whatever its turn; may be repeated")
    p.add_argument("--consent", choices=["auto", "on", "off"])
    p.add_argument("--verdict", help="preflight.json, which says for --consent auto")
    p.add_argument("--reset-in-progress", action="store_true", help="of scan: first take up what an interrupted run left")
    p.add_argument("--max-runtime", type=float, help="minutes after which no further step begins")
    p.add_argument("--concurrency", type=int, help="tasks at a time, of a local session")
    p.add_argument("--screenshots", choices=["on", "off"], default="on", help="of run-crawl: list what is to be captured")
    p.add_argument("--plan", action="store_true", help="of run-crawl: only show what there is to do")
    p.add_argument("--no-confirm", action="store_true", help="accepted; nothing here asks")
    a = p.parse_args(args)
    rules = None
    if a.rules:
        import yaml

        rules = yaml.safe_load(Path(a.rules).read_text())
    builder = SparkSession.builder.appName("cartolens")
    spark = (builder.master(f"local[{a.concurrency}]") if a.concurrency else builder).getOrCreate()
    text = lambda f: Path(f).read_text() if f else ""
    c = Crawl.open(spark, a.folder, text(a.config) or None, rules, text(a.robots),
        report__include_chrome_occurrences=a.include_chrome_occurrences or None, scan__consent=a.consent)
    budget = Budget(a.max_runtime * 60 if a.max_runtime is not None else None, c.cfg["storage"]["min_free_disk_mb"], c.folder)
    before = {s: signal.signal(s, budget.stop) for s in (signal.SIGINT, signal.SIGTERM)} if threading.current_thread() is threading.main_thread() else {}
    try:
        with c.logged(a.command):
            return _command(a, c, budget)
    except Stopped as why:
        print(f"stopped: {why}", file=sys.stderr)
        return 1
    finally:
        for s, handler in before.items():
            signal.signal(s, handler)


def _command(a: argparse.Namespace, c: Crawl, budget: Budget) -> int:
    if a.command != "status" and not a.plan:
        budget.check(c.spark)
    if a.command == "preflight":
        sample, verdict = c.preflight(a.sample)
        sample.show(a.sample, truncate=False)
        if verdict is not None:
            export.write_text(c.spark, a.out, "preflight.json", preflight.document(verdict))
    elif a.command == "inventory" or a.command == "scan" and a.tier == 1:
        c.inventory(False if a.no_crawl else None).groupBy("status").count().show()
    elif a.command == "scan":
        if a.reset_in_progress:
            c.reset()
        print(f"consent: {'on' if c.consent(a.verdict) else 'off'}")
        c.scan(a.limit, a.url).groupBy("hit").count().show()
    elif a.command == "status" or a.plan:
        for name, df in c.status().items():
            print(name)
            df.show(truncate=False)
    elif a.command == "screenshots":
        c.screenshots().show(50, truncate=False)
    elif a.command == "arcgis":
        c.arcgis(store.inventory(c.findings())[1], a.org).groupBy("in_county_org").count().show()
    elif a.command == "report":
        c.report(a.out, a.org, False if a.no_probe_keys else None)["totals"].show(truncate=False)
    else:
        c.run(a.out, a.org, budget, a.limit)["totals"].show(truncate=False)
        if a.screenshots == "on":
            c.screenshots().show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
