"""Report bundles: the reports a site check prints, as named DataFrames over logs that
are parsed once, and a registry of fleet checks that replaces ``--only`` / skip flags.

A bundle writes its parsed logs to the shared folder when it is built; every report then
reads only the columns it needs from there."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from ..operators import fleet, fleetlog, traffic, watchdog
from ..session import shared_dir
from ..sources import lines as src_lines
from ..sources.parse import parse_access, parse_php_error, parse_watchdog
from ..sources.tables import write_report


def access_log_report(spark: SparkSession, log_dir: str, site: str, slow_s: float = traffic.SLOW_SECONDS,
                      recent_lines: int | None = None, disk: DataFrame | None = None) -> dict[str, DataFrame]:
    """Everything the access/error log check reports for one site, from
    ``access.log*`` and ``php-errors.log*`` in ``log_dir`` (plain or gzip).
    ``recent_lines`` is a preview of the last lines of every file; ``disk`` holds the
    hosts' ``df -k`` lines (host, value), for the low-space report."""
    acc_lines = src_lines.read_lines(spark, os.path.join(log_dir, "access.log*"))
    err_lines = src_lines.read_lines(spark, os.path.join(log_dir, "php-errors.log*"))
    if recent_lines:
        acc_lines = src_lines.last_n_lines(acc_lines, recent_lines)
        err_lines = src_lines.last_n_lines(err_lines, recent_lines)
    access = _parsed_once(parse_access(acc_lines), "access")
    errors = _parsed_once(parse_php_error(err_lines), "php-errors")
    low = {"low_disk_space": fleetlog.low_disk_space(disk)} if disk is not None else {}
    return low | {
        "log_sizes": src_lines.file_sizes(spark, os.path.join(log_dir, "*.log")),
        "hourly_traffic": traffic.hourly_traffic(access, site, slow_s),
        "top_slow": traffic.top_slow(access, site, slow_s),
        "top_error_paths": traffic.top_error_paths(access),
        "top_error_paths_hourly": traffic.top_error_paths_hourly(access),
        "paged_hits_by_agent": traffic.paged_hits_by_agent(access),
        "latest_cron_calls": traffic.latest_matching(access, "GET /cron.php"),
        "top_errors": traffic.top_errors(errors),
        "oom_paths": traffic.oom_paths(errors, access),
    }


def _parsed_once(df: DataFrame, name: str) -> DataFrame:
    path = shared_dir(df.sparkSession, f"parsed-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def watchdog_report(spark: SparkSession, path: str, today: str, n_files: int = 5) -> dict[str, DataFrame]:
    """The application-log check for one log (either layout): types, top messages of
    the two largest types, not-found paths, recent cron runs, and module changes in
    the ``n_files`` newest rotated files."""
    log = _parsed_once(parse_watchdog(src_lines.read_lines(spark, path)), "watchdog")
    newest = src_lines.newest_files(spark, path + "*", n_files)
    rotated = parse_watchdog(src_lines.read_lines(spark, newest)) if newest else log
    return {
        "top_types": watchdog.top_types(log),
        "top_messages_per_type": watchdog.top_messages_per_type(log),
        "top_not_found": watchdog.top_not_found(log),
        "recent_cron": watchdog.recent_cron(log),
        "module_changes": watchdog.module_changes(rotated, today),
    }


# Fleet checks by name: each takes the check's input DataFrame(s) and options.
CHECKS: dict[str, Callable[..., DataFrame]] = {
    "email_volume": fleetlog.mail_per_day,
    "syslog_check": fleetlog.syslog_events,
    "daemonlog_check": fleetlog.literal_events,
    "fpm_skips": lambda df, **kw: fleetlog.skip_spawns(df, "fpm", **kw),
    "cgi_skips": lambda df, **kw: fleetlog.skip_spawns(df, "webserver", **kw),
    "fpm_errors": fleetlog.count_literal_by_host,
    "nagios_downtime": fleetlog.downtime_events,
    "tasks": fleetlog.flag_tasks,
    "disk": fleetlog.low_disk_space,
    "webs_cpu": fleetlog.busy_cpu,
    "max_conn": fleetlog.connection_limits,
    "php_memory_limit": fleetlog.memory_limits,
    "audit": fleetlog.audit_errors,
    "external_connections": fleetlog.external_connections,
    "anonsession": fleetlog.session_status,
    "code_deploy": fleet.drift,
    "hosting_release_version": fleet.version_drift,
    "varnish_stats": fleet.uncached_ratio,
    "phpcgi_procs": fleet.process_capacity,
    "phpfpm_procs": fleet.flat_capacity,
    "dns": fleet.domain_status,
    "modules": fleet.match_lists,
    "module_count": fleet.count_over,
    "module_updates": fleet.update_status,
    "cacheaudit": fleet.cache_audit,
    "php_session_gc": fleet.flag_overrides,
    "block_cache": fleet.block_cache,
    "pressflow": fleet.classify_version,
    "dbsize_engines": fleet.storage_by_engine,
    "dbsize_tables": fleet.largest_tables,
    "dbsize_cache_form": fleet.large_payloads,
    "vars": fleet.variable_stats,
    "anon_sessions_table": fleet.anonymous_sessions,
    "cacheflushes": fleet.flush_ages,
    "duplicatemodules": fleet.duplicate_modules,
}


def run_checks(inputs: dict[str, tuple], only: Iterable[str] | None = None, skip: Iterable[str] = (),
               options: dict[str, dict] | None = None) -> dict[str, DataFrame]:
    """Build the selected checks: ``inputs[name]`` holds the check's positional
    DataFrame arguments, ``options[name]`` its keyword options.  Checks without
    input are left out (the report skips what it cannot see)."""
    chosen = list(only) if only else list(CHECKS)
    skip = set(skip)
    options = options or {}
    out = {}
    for name in chosen:
        if name in skip or name not in inputs:
            continue
        out[name] = CHECKS[name](*inputs[name], **options.get(name, {}))
    return out


def write_reports(reports: dict[str, DataFrame], out_dir: str) -> dict[str, str]:
    """Write every report as parquet under ``out_dir/<name>``."""
    return {name: write_report(df, os.path.join(out_dir, name)) for name, df in reports.items()}
