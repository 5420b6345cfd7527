"""Configuration: a YAML document merged over defaults (objects merge, arrays and scalars replace, null keeps the default)."""

from __future__ import annotations

import copy
from typing import Any

from . import fixed

DEFAULTS: dict[str, Any] = {
    "scope": {"crawl_allowlist": [], "normalize_to_www": {}, "domain": "", "portal": ""},
    "seeds": {"homepage": None, "sitemaps": []},
    "inventory": {"max_urls": 50_000, "bfs_link_crawl": True, "run_tier1_during_crawl": True, "skip_extensions": [], "strip_query_params": [], "store_html": "all"},
    "detection": {"vendors": [], "record_links": True, "links_trigger_render": True},
    "http": {"requests_per_second_per_host": 2, "respect_crawl_delay": True, "max_retries": 3, "retry_backoff_ms": 15_000, "block_window": 25,
        "block_threshold": 8, "max_html_bytes": 5_000_000, "user_agent_token": "cartolens"},
    "scan": {"tier2_sample_rate": 0.2, "stale_in_progress_minutes": 10, "record_all_requests": True, "max_requests_per_page": 400, "consent": "auto"},
    "arcgis": {"item_types": []},
    "report": {"vendors": [], "probe_api_keys": True, "dir": "output", "include_chrome_occurrences": False},
    "storage": {"min_free_disk_mb": 200},
}


def merge(base: Any, over: Any) -> Any:
    if isinstance(base, dict) and isinstance(over, dict):
        return {k: merge(base.get(k), over.get(k)) for k in [*base, *[k for k in over if k not in base]]}
    return copy.deepcopy(base if over is None else over)


def load(source: dict | str | None = None, **overrides: Any) -> dict[str, Any]:
    """From a mapping or YAML text; ``overrides`` like ``scan__consent="on"`` come last and are ignored when None."""
    if isinstance(source, str):
        import yaml

        source = yaml.safe_load(source) or {}
    cfg = merge(DEFAULTS, source or {})
    for name, value in overrides.items():
        if value is not None:
            *path, last = name.split("__")
            at = cfg
            for p in path:
                at = at.setdefault(p, {})
            at[last] = value
    return cfg


#: What most crawls use.
USUAL = {"inventory": {"skip_extensions": fixed.ASSET_EXTENSIONS, "strip_query_params": fixed.TRACKING}}
