"""robots.txt: parsing on the driver (it is one small file a host), matching as a column."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import dropwhile, groupby, zip_longest

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import small


@dataclass
class Robots:
    rules: list[tuple[bool, str]] = field(default_factory=list)
    sitemaps: list[str] = field(default_factory=list)
    crawl_delay: float | None = None

    def is_allowed(self, path: str) -> bool:
        """The longest matching path decides, allowing wins a tie, and so does having no match. Case matters."""
        hits = [(len(p), ok) for ok, p in self.rules if re.search(path_regex(p), path)]
        return max(hits)[1] if hits else True

    def allowed(self, path: Column) -> Column:
        """The same for a column of path and query; rules are literals, tried from the one that decides first."""
        order = sorted(self.rules, key=lambda r: (-len(r[1]), not r[0]))
        return F.coalesce(*[F.when(path.rlike(path_regex(p)), F.lit(ok)) for ok, p in order], F.lit(True))

    def interval_ms(self, per_second: float, respect: bool = True) -> float:
        """Milliseconds between two fetches from a host."""
        own = 1000 / max(0.01, per_second or 2)
        return max(own, self.crawl_delay * 1000) if respect and self.crawl_delay and self.crawl_delay > 0 else own


def path_regex(pattern: str) -> str:
    end = pattern.endswith("$")
    return "^" + ".*".join(re.escape(p) for p in pattern.removesuffix("$").split("*")) + ("$" if end else "")


#: A line of a group: a field and its value, comments cut off.
_LINE = re.compile(r"^[ \t]*([A-Za-z-]+)[ \t]*:[ \t]*([^#\r\n]*)", re.M)


def fields(text: str) -> list[tuple[str, str]]:
    return [(name.lower(), value.strip()) for name, value in _LINE.findall(text)]


def groups(lines: list[tuple[str, str]]) -> list[tuple[list[str], list[tuple[str, str]]]]:
    """(agents, lines) of each group: a run of agents and the run of rules that follows it; rules before any agent are for all."""
    runs = [(agents, list(run)) for agents, run in groupby((x for x in lines if x[0] in ("user-agent", "allow", "disallow", "crawl-delay")),
        lambda x: x[0] == "user-agent")]
    if runs and not runs[0][0]:
        opening = list(dropwhile(lambda x: x[0] == "crawl-delay", runs[0][1]))
        runs[:1] = [(True, [("user-agent", "*")]), (False, opening)] if opening else []
    return [([v.lower() for _, v in agents], rules) for (_, agents), (_, rules) in zip_longest(runs[::2], runs[1::2], fillvalue=(False, []))]


def parse(text: str, agent: str) -> Robots:
    """Rules of the first group that names a part of ``agent``, else of the first for all. Groups are not merged."""
    lines = fields(text)
    found = groups(lines)
    mine = [rules for names, rules in found if any(n != "*" and n in agent.lower() for n in names)]
    rules = next(iter(mine or [rules for names, rules in found if "*" in names]), [])
    delays = [v for name, v in rules if name == "crawl-delay"][-1:]
    return Robots(
        [(name == "allow", v) for name, v in rules if name != "crawl-delay" and v], [v for name, v in lines if name == "sitemap" and v],
        next((float(v) for v in delays if re.fullmatch(r"\d+(\.\d+)?", v)), None),
    )


def allowed_join(urls: DataFrame, rules: DataFrame, path: str = "path") -> DataFrame:
    """``urls`` with ``allowed``, for robots rules that are a (small, broadcast) table (allow, pattern, regex): longest match."""
    keyed = urls.select(path).distinct()
    best = F.max_by("allow", F.struct(F.length("pattern"), F.col("allow")))
    met = keyed.join(small(rules), F.expr(f"{path} rlike regex")).groupBy(path).agg(best.alias("allowed"))
    return urls.join(met, path, "left").withColumn("allowed", F.coalesce("allowed", F.lit(True)))
