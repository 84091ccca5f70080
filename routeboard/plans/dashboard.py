"""The whole dashboard as one Spark application: one normalised base, 16 reports, 7 derived tables.

The page the reports come from re-ran the same 45-line normalisation for each
of its 16 queries, each a full scan.  Here:

* the raw fact is normalised once and written as Parquet to the shared
  checkpoint folder (lineage cut, column pruning and row-group skipping for
  every later scan);
* reports that share a grouping share one aggregation: a per-bucket table
  feeds the activity, active-chain and moving-average reports, a global one
  the two KPI rows, a per-user one the three class breakdowns, a per-route one
  the route profile and route totals, a per-day first-seen table the two
  new-user reports.  What has a small domain (days, chains, tokens, volumes)
  comes from one table of daily cells;
* with a ``ResultStore`` the base and every table made from it are kept under
  the version of their source: a later page, also in another process, reads
  them and scans neither the source nor the base (``made`` tells what it had to
  make);
* report results that feed derived tables are persisted (one row per bucket,
  class or route), so a derived table never re-scans the base.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import derived, reports
from ..operators.normalize import normalize
from ..params import CLASS_WINDOW, ReportParams
from ..sources.schema import BASE_COLUMNS
from ..sources.reuse import ResultStore, source_bytes, source_version
from ..sources.storage import sized_shuffles, write_and_reload
from ..sources.tables import read_fact

REPORT_NAMES = (
    "r01_overview_kpis", "r02_activity_over_time", "r03_quarterly_cumulative", "r04_chain_kpis",
    "r05_active_chains", "r06_moving_average", "r07_txn_ranges", "r08_new_users",
    "r09_new_user_kpis", "r10_txn_exact", "r11_active_days", "r12_paths_per_user",
    "r13_heatmap", "r14_route_profile", "r15_source_destination", "r16_route_totals",
)
DERIVED_NAMES = (
    "d1_heatmap_transfers", "d2_heatmap_volume", "d3_routes_numbered", "d4_top_volume",
    "d5_top_transfers", "d6_top_long", "d7_share_txn_ranges", "d7_share_txn_exact",
    "d7_share_active_days", "d7_share_paths",
)
# the report each derived table is drawn from
DERIVED_SOURCE = {
    "d1_heatmap_transfers": "r13_heatmap",
    "d2_heatmap_volume": "r13_heatmap",
    "d3_routes_numbered": "r14_route_profile",
    "d4_top_volume": "r16_route_totals",
    "d5_top_transfers": "r16_route_totals",
    "d6_top_long": "r16_route_totals",
    "d7_share_txn_ranges": "r07_txn_ranges",
    "d7_share_txn_exact": "r10_txn_exact",
    "d7_share_active_days": "r11_active_days",
    "d7_share_paths": "r12_paths_per_user",
}
# the measure tables that a report is finished from
NEEDS = {
    "r01_overview_kpis": ("m_cells", "m_overall"), "r02_activity_over_time": ("m_cells", "m_buckets"),
    "r03_quarterly_cumulative": ("m_cells",), "r04_chain_kpis": ("m_cells", "m_overall"),
    "r05_active_chains": ("m_cells", "m_buckets"), "r06_moving_average": ("m_cells", "m_buckets"),
    "r07_txn_ranges": ("m_users", "m_users_class_window"), "r08_new_users": ("m_daily_new_users",),
    "r09_new_user_kpis": ("m_daily_new_users",), "r10_txn_exact": ("m_users",), "r11_active_days": ("m_users",),
    "r12_paths_per_user": ("m_users",), "r13_heatmap": ("m_heatmap",),
    "r14_route_profile": ("m_cells", "m_routes", "m_route_medians"), "r15_source_destination": ("m_pairs",),
    "r16_route_totals": ("m_cells", "m_routes"),
}
_BY_BUCKET = ("m_buckets",)      # the only measure table that depends on the grain
# report results that derived tables read
_FEEDS = tuple(sorted(set(DERIVED_SOURCE.values())))


def materialize_base(base: DataFrame, cluster: bool = False, path: str | None = None,
                     partition_by_month: bool = False) -> DataFrame:
    """Write the normalised relation once and read it back.

    ``path`` is a location the caller manages (overwritten); by default a new
    folder under the shared checkpoint directory, which the caller removes
    with the rest of that directory's contents.

    By default each task writes its own rows sorted by date (no shuffle).  A
    transfer fact is appended in time order, so a task's input -- and the file
    it writes -- covers a narrow span of dates, and Parquet statistics let a
    report's date range skip row groups.  ``cluster=True`` is for facts that are
    not stored in time order: rows are range-partitioned on ``(created_date,
    row hash)`` first, so every file covers a narrow date span whatever the
    input order (the hash tie-break spreads a date holding a large share of all
    transfers over many files).  It costs one shuffle of the base plus the
    sampling pass that range partitioning makes over its input.
    ``partition_by_month=True`` writes one directory per month instead, for
    very long histories.
    """
    cols = base.select(*BASE_COLUMNS)
    if partition_by_month:
        # one directory per month: a report's range prunes whole directories
        # (``in_range`` filters the month column too); REBALANCE lets AQE split
        # a heavy month over several files and merge light ones
        cols = cols.withColumn("created_month", F.trunc("created_date", "month")).hint("rebalance", "created_month")
        return write_and_reload(cols, "base", sort_by=("created_date",), partition_by=("created_month",),
                                path=path)
    cluster_by = (F.col("created_date"), F.xxhash64(*BASE_COLUMNS)) if cluster else ()
    return write_and_reload(cols, "base", sort_by=("created_date",), cluster_by=cluster_by, path=path)


class Dashboard:
    """All reports for one set of parameters over one normalised base."""

    def __init__(self, base: DataFrame, params: ReportParams = ReportParams(),
                 class_window: ReportParams = CLASS_WINDOW,
                 first_seen: DataFrame | None = None, store: ResultStore | None = None, version: str | None = None):
        """``first_seen``: a maintained ``(user_address, first_txn_date)`` table
        (``streaming.first_seen_table``); without it the new-user reports
        derive first dates from the whole base.  ``store`` keeps the measure
        tables for later pages, under ``version``: that of the source ``base``
        was made from (``source_version(base)`` by default)."""
        self.base = base
        self.params = params
        self.class_window = class_window
        self.first_seen = first_seen
        self.store = store
        self.version = version or (source_version(base) if store is not None else None)

    @classmethod
    def from_fact(cls, fact: DataFrame, params: ReportParams = ReportParams(),
                  materialize: bool = True, cluster: bool = False, partition_by_month: bool = False,
                  **kw) -> "Dashboard":
        """From a raw fact (``id, created_at, status, simplified_status, data``; see ``sources.tables.read_fact``)."""
        fact = read_fact(fact.sparkSession, fact)
        base = normalize(fact, fold_case=False)
        if kw.get("store") is not None:
            return cls._kept(base, params, **kw)
        if materialize:
            base = materialize_base(base, cluster, partition_by_month=partition_by_month)
        return cls(base, params, **kw)

    @classmethod
    def from_base(cls, base: DataFrame, params: ReportParams = ReportParams(),
                  materialize: bool = True, cluster: bool = False, partition_by_month: bool = False,
                  **kw) -> "Dashboard":
        """From an already normalised relation (``BASE_COLUMNS``, chains unfolded)."""
        if kw.get("store") is not None:
            return cls._kept(base, params, **kw)
        if materialize:
            base = materialize_base(base, cluster, partition_by_month=partition_by_month)
        return cls(base, params, **kw)

    @classmethod
    def _kept(cls, base: DataFrame, params: ReportParams, store: ResultStore, version: str | None = None, **kw) -> "Dashboard":
        """Over the base that ``store`` keeps for this version of the source.

        The task that writes a file also sorts it, so the base is made with
        shuffles that are sized by the source (``sized_shuffles``).
        """
        version = version or source_version(base)
        make = lambda: base.select(*BASE_COLUMNS).sortWithinPartitions("created_date")
        stored = 0 if store.has(version, "base") else source_bytes(base)
        with sized_shuffles(base.sparkSession, stored):
            kept = store.table(version, "base", make)
        return cls(kept, params, store=store, version=version, **kw)

    # -- lazily built plans --------------------------------------------------
    def shared_plans(self) -> dict[str, Callable[[], DataFrame]]:
        """Measure tables several reports finish from; each is one scan + one aggregation."""
        b, p = self.base, self.params
        plans = {
            "m_cells": lambda: reports.daily_cells(b, p),
            "m_overall": lambda: reports.distinct_transfers(b, p),
            "m_buckets": lambda: reports.distinct_transfers(b, p, reports.bucket_of(p)),
            "m_users": lambda: reports.user_measures(b, p),
            "m_routes": lambda: reports.distinct_transfers(b, p, reports.route_of()),
            "m_route_medians": lambda: reports.route_medians(b, p),
            "m_heatmap": lambda: reports.heatmap(b, p),
            "m_pairs": lambda: reports.source_destination(b, p),
            "m_daily_new_users": lambda: reports.daily_new_users(b, p, self.first_seen),
        }
        if self.class_window != p:
            plans["m_users_class_window"] = lambda: reports.user_measures(b, self.class_window, ("_txns",))
        return plans

    def _measure(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A measure table: kept ones are read, or made and kept."""
        if self.store is None or (name == "m_daily_new_users" and self.first_seen is not None):
            return make()
        p = self.class_window if name == "m_users_class_window" else self.params
        parameters = {"start": p.start, "end": p.end, **({"grain": p.grain} if name in _BY_BUCKET else {})}
        return self.store.table(self.version, name, make, **parameters)

    def report(self, name: str) -> DataFrame:
        """One report, finished from the measure tables it needs (kept ones with a store)."""
        shared = self.shared_plans()
        measures = {n: self._measure(n, shared[n]) for n in NEEDS[name] if n in shared}
        return self.report_plans(measures)[name]()

    def report_plans(self, m: dict[str, DataFrame]) -> dict[str, Callable[[], DataFrame]]:
        """The sixteen reports, finished from the shared measure tables ``m`` where they can be."""
        b, p = self.base, self.params
        class_users = lambda: m.get("m_users_class_window", m["m_users"])
        overall = lambda: reports.overall_from_cells(m["m_cells"], m["m_overall"])
        buckets = lambda: reports.buckets_from_cells(m["m_cells"], m["m_buckets"], p)
        routes = lambda: reports.routes_from_cells(m["m_cells"], m["m_routes"])
        return {
            "r01_overview_kpis": lambda: reports.overview_kpis(b, p, measures=overall()),
            "r02_activity_over_time": lambda: reports.activity_over_time(b, p, measures=buckets()),
            "r03_quarterly_cumulative": lambda: reports.quarters_from_cells(m["m_cells"], p),
            "r04_chain_kpis": lambda: reports.chain_kpis(b, p, measures=overall()),
            "r05_active_chains": lambda: reports.active_chains(b, p, measures=buckets()),
            "r06_moving_average": lambda: reports.moving_average(b, p, measures=buckets()),
            "r07_txn_ranges": lambda: reports.txn_ranges(b, self.class_window, measures=class_users()),
            "r08_new_users": lambda: reports.new_users(b, p, daily=m["m_daily_new_users"]),
            "r09_new_user_kpis": lambda: reports.new_user_kpis(b, p, daily=m["m_daily_new_users"]),
            "r10_txn_exact": lambda: reports.txn_exact(b, p, measures=m["m_users"]),
            "r11_active_days": lambda: reports.active_days(b, p, measures=m["m_users"]),
            "r12_paths_per_user": lambda: reports.paths_per_user(b, p, measures=m["m_users"]),
            "r13_heatmap": lambda: m["m_heatmap"].orderBy(*reports.heatmap_order()),
            "r14_route_profile": lambda: reports.route_profile(b, p, measures=routes(), medians=m["m_route_medians"]),
            "r15_source_destination": lambda: m["m_pairs"].orderBy(*reports.pairs_order()),
            "r16_route_totals": lambda: reports.route_totals(b, p, measures=routes()),
        }

    @staticmethod
    def derived_plans(r: dict[str, DataFrame]) -> dict[str, Callable[[], DataFrame]]:
        return {
            "d1_heatmap_transfers": lambda: derived.heatmap_transfers(r["r13_heatmap"]),
            "d2_heatmap_volume": lambda: derived.heatmap_volume(r["r13_heatmap"]),
            "d3_routes_numbered": lambda: derived.routes_numbered(r["r14_route_profile"]),
            "d4_top_volume": lambda: derived.top_volume(r["r16_route_totals"]),
            "d5_top_transfers": lambda: derived.top_transfers(r["r16_route_totals"]),
            "d6_top_long": lambda: derived.top_long(derived.top_transfers(r["r16_route_totals"])),
            "d7_share_txn_ranges": lambda: derived.share_of_users(r["r07_txn_ranges"]),
            "d7_share_txn_exact": lambda: derived.share_of_users(r["r10_txn_exact"]),
            "d7_share_active_days": lambda: derived.share_of_users(r["r11_active_days"]),
            "d7_share_paths": lambda: derived.share_of_users(r["r12_paths_per_user"]),
        }

    # -- execution -------------------------------------------------------------
    def run(self, action: Callable[[DataFrame], object] | None = None,
            parallel: int = 1) -> tuple[dict[str, object], dict[str, float]]:
        """Build the shared measure tables, then the reports, then every derived table.

        Measure tables are persisted (MEMORY_AND_DISK; a lost block is
        recomputed from the materialised base) and released at the end.
        ``action`` turns a plan into a result (default: ``collect`` -- report
        outputs are bounded by their group domains).  ``parallel`` submits
        that many Spark jobs at once from driver threads; Spark schedules
        their tasks side by side.  Returns ``(results, seconds)``; ``seconds``
        also holds the time of each measure table (``m_*``).
        """
        action = action or (lambda df: df.collect())
        results: dict[str, object] = {}
        seconds: dict[str, float] = {}
        frames: dict[str, DataFrame] = {}

        def timed(name: str, make: Callable[[], DataFrame], keep: bool, act) -> None:
            t0 = time.perf_counter()
            df = self._measure(name, make) if name in shared else make()
            if keep:
                df = df if name in shared and self.store is not None else df.persist(StorageLevel.MEMORY_AND_DISK)
                frames[name] = df
            results[name] = act(df)
            seconds[name] = time.perf_counter() - t0

        def run_all(plans: dict[str, Callable[[], DataFrame]], keep: tuple[str, ...],
                    act_for: Callable[[str], Callable[[DataFrame], object]] = lambda _: action) -> None:
            if parallel <= 1:
                for name, make in plans.items():
                    timed(name, make, name in keep, act_for(name))
                return
            with ThreadPoolExecutor(max_workers=parallel) as pool:
                futures = [pool.submit(timed, n, m, n in keep, act_for(n)) for n, m in plans.items()]
                for f in futures:
                    f.result()

        shared = self.shared_plans()
        try:
            run_all(shared, tuple(shared), lambda n: (lambda df: None) if self.store is not None else (lambda df: df.count()))
            measures = {n: frames[n] for n in shared}
            run_all(self.report_plans(measures), _FEEDS)
            run_all(self.derived_plans(frames), ())
        finally:
            for df in frames.values():
                df.unpersist()
        for n in shared:
            results.pop(n, None)
        return results, seconds
